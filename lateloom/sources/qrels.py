"""Relevance judgements from text lines of 2 to 4 columns, lenient, or of exactly 4, strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateloom.params import DuplicatePair, MalformedQrelsLine


def parse_lines(lines: DataFrame, *, column: str = "value", min_rel: int = 1, strict: bool = False) -> DataFrame:
    """qid, doc_id, rel and error (null, or why the line is malformed) of every line that counts.

    Fields are parted by runs of tabs or spaces; one carriage return at the end goes; empty lines and those that begin with # are
    skipped. Two fields are a query and a document with relevance 1; three add the relevance; four have an unused second one.
    The relevance decides before the ids are read (strict: after). A line of white space alone is malformed.
    """
    raw = lines.select(F.regexp_replace(F.col(column), r"\r$", "").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    f = F.filter(F.split("line", "[\t ]+"), lambda x: x != "")
    rows = raw.withColumn("f", f).withColumn("n", F.size("f"))
    at = lambda i: F.expr(f"try_element_at(f, {i})")
    rel_text = F.when(F.col("n") == 2, F.lit("1")).when(F.col("n") == 3, at(3)).when(F.col("n") == 4, at(4))
    doc_text = F.when(F.col("n") == 4, at(3)).otherwise(at(2))
    wrong = (F.col("n") != 4) if strict else ~F.col("n").between(2, 4)
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    rows = rows.withColumns({"rel_text": rel_text, "doc_text": doc_text, "qid_text": at(1)})
    rows = rows.withColumns({"rel": F.expr("try_cast(rel_text AS INT)"), "doc_id": number("doc_text"), "qid": number("qid_text")})
    low = F.coalesce(F.col("rel") < min_rel, F.lit(False))
    no_id = F.col("qid").isNull() | F.col("doc_id").isNull() | (F.col("qid") < 0) | (F.col("doc_id") < 0)
    kept_error = F.when(no_id, "id")
    by_relevance = F.when(no_id, "id") if strict else F.when(low, F.lit(None).cast("string")).otherwise(kept_error)
    error = F.when(wrong, "columns").when(F.col("rel").isNull(), "relevance").otherwise(by_relevance)
    return rows.select("qid", "doc_id", "rel", error.alias("error")).where(F.col("error").isNotNull() | ~low)


def duplicates(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).groupBy("qid", "doc_id").agg(F.count("*").alias("n")).where("n > 1")


def load(spark: SparkSession, path: str, *, min_rel: int = 1, strict: bool = False) -> DataFrame:
    """qid, doc_id and rel of a file, or an error: malformed lines and repeated pairs are refused."""
    parsed = parse_lines(spark.read.text(path), min_rel=min_rel, strict=strict)
    if bad := parsed.where(F.col("error").isNotNull()).take(1):
        raise MalformedQrelsLine(f"{bad[0]['error']}: {bad[0].asDict()}")
    if twice := duplicates(parsed).take(1):
        raise DuplicatePair(str(twice[0].asDict()))
    return parsed.select("qid", "doc_id", "rel")
