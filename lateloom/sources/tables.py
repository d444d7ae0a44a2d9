"""The data model as tables: tokens(doc_id, pos, token_id, vec), query_tokens(qid, qpos, vec), qrels(qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateloom.params import MAX_DIM, MAX_ID, EmptyTokenDump, InvalidTokenDump


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens_from_embeddings(embeddings: DataFrame, per_doc: int = 10, fine: int | None = None) -> DataFrame:
    """Views embeddings(vec_id, embedding, label) as documents of per_doc tokens; token ids are labels, or vec_id modulo fine."""
    token = F.col("label").cast("long") if fine is None else F.col("vec_id") % fine
    return embeddings.select(
        F.expr(f"vec_id div {per_doc}").alias("doc_id"), (F.col("vec_id") % per_doc).cast("int").alias("pos"), token.alias("token_id"), F.col("embedding").cast("array<double>").alias("vec")
    )


def _asked(embeddings: DataFrame, every: int, per_query: int) -> DataFrame:
    """qid, qpos and the vectors of query tokens: a query for each run of every ids, per_query in a row from its first (or, in every second run, from its ninth, where two documents meet)."""
    place = F.col("vec_id") % every - F.when(F.expr(f"vec_id div {every}") % 2 == 1, 8).otherwise(0)
    return embeddings.where(place.between(0, per_query - 1)).withColumns({"qid": F.expr(f"vec_id div {every}") + 1, "qpos": place.cast("int")})


def queries_from_embeddings(embeddings: DataFrame, every: int = 50, per_query: int = 4) -> DataFrame:
    """A set of queries that grows with the table."""
    return _asked(embeddings, every, per_query).select("qid", "qpos", F.col("embedding").cast("array<double>").alias("vec"))


def qrels_from_embeddings(embeddings: DataFrame, every: int = 50, per_query: int = 4, per_doc: int = 10) -> DataFrame:
    """The documents that hold a query's tokens, and how many."""
    pairs = _asked(embeddings, every, per_query).select("qid", F.expr(f"vec_id div {per_doc}").alias("doc_id"))
    return pairs.groupBy("qid", "doc_id").agg(F.count("*").cast("int").alias("rel"))


def validation(tokens: DataFrame) -> DataFrame:
    """One row of figures about a token table, by one aggregation."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    docs = tokens.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.countDistinct("pos").alias("d"),
        F.min(F.size("vec")).alias("dim_lo"), F.max(F.size("vec")).alias("dim_hi"), F.sum(bad.cast("int")).alias("bad"),
        F.sum(((F.col("token_id") < 0) | (F.col("token_id") > MAX_ID) | F.col("token_id").isNull()).cast("int")).alias("bad_ids"),
    )
    broken = ((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n"))).cast("int")
    zero = F.lit(0).cast("long")
    return docs.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), zero).alias("n_tokens"), F.min("dim_lo").alias("dim_min"), F.max("dim_hi").alias("dim_max"),
        F.coalesce(F.sum("bad"), zero).alias("n_not_finite"), F.coalesce(F.sum("bad_ids"), zero).alias("n_bad_ids"), F.coalesce(F.sum(broken), zero).alias("n_broken_docs"),
    )


def validate(tokens: DataFrame) -> dict[str, int]:
    """Raises unless tokens is a sound token table; its figures otherwise."""
    r = validation(tokens).first().asDict()
    if not r["n_tokens"]:
        raise EmptyTokenDump("there are no tokens")
    if r["dim_min"] != r["dim_max"] or not 0 < r["dim_min"] <= MAX_DIM:
        raise InvalidTokenDump(f"dimensions from {r['dim_min']} to {r['dim_max']}")
    for k in ("n_not_finite", "n_bad_ids", "n_broken_docs"):
        if r[k]:
            raise InvalidTokenDump(f"{k} is {r[k]}")
    return r


def with_query_ids(ordinals: DataFrame, ids: DataFrame | None) -> DataFrame:
    """qid for each ordinal (from 0): from ids(ordinal, qid) where given, otherwise ordinal + 1."""
    if ids is None:
        return ordinals.withColumn("qid", F.col("ordinal") + 1)
    return ordinals.join(ids, "ordinal", "left").withColumn("qid", F.coalesce("qid", F.col("ordinal") + 1))


def id_map(external: DataFrame, column: str) -> DataFrame:
    """Dense numbers from 0 for external ids, in their order. Numbered inside ranges, so no task holds all."""
    from pyspark.sql import Window as W

    dealt = external.select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id())
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    begins = counts.withColumn("begin", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "begin")  # a row for each task
    rank = F.row_number().over(W.partitionBy("part").orderBy(column)) - 1
    return dealt.withColumn("rank", rank).join(F.broadcast(begins), "part").select((F.col("begin") + F.col("rank")).alias("number"), column)
