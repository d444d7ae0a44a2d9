"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and lets its operator's decisions take effect."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, ngram_join, packing, suffix_dedup, toxicity
from ._shared import materialize, small_batches, table, temporary

#: A document with this score, or more, is rejected as toxic.
TOXIC = 0.7
#: Word shingles and least similarity, in hundredths, of near copies and of leaked test items.
SHINGLE, PERCENT = 5, 80
#: Bytes of a repeated passage.
PASSAGE = 200


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """Tables that a stage's result reads stay as long as the session: results may be read at any time, and in any order. Who knows that a result has been read deletes them (tables(), discard())."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents, row by row. Empty and null texts stay. The model learns from labelled rows of docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    keep = tuple(f"own_{c}" for c in docs.columns)
    scored = toxicity.score_documents(docs.toDF(*keep), model, key="own_doc_id", text="own_text", keep=keep)
    return scored.where(F.col("score") < TOXIC).select(*keep).toDF(*docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one of least doc_id (a null is greatest), of these that of least checksum.

    Rows are told apart by two checksums of all their columns, not by doc_id: rows with one id and different texts stay, and of rows
    that are equal in all columns one stays. Rows without words stay. docs is read again by the result, and nothing but checksums is
    stored beside it. Two different rows with the same first checksum, should there be any, both stay.
    """
    one, two = _free(docs, "row"), _free(docs, "row2")
    plain = [F.col(f"`{f.name}`") if f.dataType.typeName() not in ("map", "struct", "array", "variant") else F.col(f"`{f.name}`").cast("string") for f in docs.schema]
    summed = docs.withColumns({one: F.xxhash64(*plain), two: F.xxhash64(F.lit(2), *reversed(plain))})
    with temporary() as result:
        rows = materialize(summed.groupBy(one, two).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
        alone = rows.groupBy(one).agg(F.first(two).alias(two), F.first("id").alias("id"), F.first("copies").alias("copies"), F.count("*").alias("with")).where("with = 1")
        groups = ngram_join.jaccard_components(summed, size=SHINGLE, percent=PERCENT, key=one).where("n_shingles > 0").select(one, "component_id").distinct()
        order = F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col(one).alias("at"))
        groups = materialize(groups.join(alone, one).select(one, two, "component_id", "copies", order.alias("order")))
        stays = groups.groupBy("component_id").agg(F.min("order").alias("first"))
        ranked = groups.join(stays, "component_id").withColumn("goes", F.col("order.at") != F.col("first.at"))
        changed = result(ranked.where("goes OR copies > 1").select(one, two, "goes"))
    kept = summed.join(changed, [one, two], "left_anti")
    if changed.where("NOT goes").limit(1).count():
        kept = kept.unionByName(summed.join(changed.where("NOT goes"), [one, two], "left_semi").dropDuplicates([one, two]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of PASSAGE bytes that also starts elsewhere; a document of which nothing is left goes, one that was empty stays."""
    own = [f"own_{c}" for c in docs.columns]
    renamed = docs.toDF(*own).withColumn("was_null", F.col("own_text").isNull())
    cut = suffix_dedup.remove_repeats(renamed, length=PASSAGE, text="own_text", keep=(*(c for c in own if c != "own_text"), "was_null"), out="text")
    changed = F.col("n_removed") > 0
    left = cut.where(~changed | (F.length(F.trim("kept_text")) > 0)).withColumn("own_text", F.when(~F.col("was_null"), F.col("kept_text")))
    if "own_n_chars" in own:
        left = left.withColumn("own_n_chars", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("own_n_chars")))
    return left.select(*own).toDF(*docs.columns)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a test item, row by row."""
    return decontamination.without_contained(docs, table(spark, sf_dir, "benchmark"), size=SHINGLE, percent=PERCENT)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), most=1024, end_id=2)
