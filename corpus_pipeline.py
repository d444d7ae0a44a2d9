"""From documents to training sequences: toxic documents go, near copies go, repeated passages are cut, leaked test items go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lateloom.functions.ship import ship
from lateloom.llm import stages
from lateloom.llm._shared import discard, tables, temporary

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.drop_near_copies),
    ("suffix_array_dedup", stages.cut_repeats),
    ("benchmark_decontamination", stages.drop_leaks),
    ("best_fit_packing", stages.pack),
]

#: SQL can express neither the toxicity model nor packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is a table that the next one reads."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: list[str] = []
    for _, stage in STAGES:
        before = set(tables())
        with temporary() as result:
            docs = result(stage(spark, docs, sf_dir))
        discard(read)
        read = [t for t in tables() if t not in before]
    return docs
