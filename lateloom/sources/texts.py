"""Made texts with three themes, to try encoders and searches on: documents of one theme share most of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateloom.functions.sampling import draw

#: By theme a sentence's frame, and what its two gaps are filled with.
THEMES = {
    "garden": ("The %s near the gate needs %s before summer comes.", ["rose", "old apple tree", "hedge", "lawn", "herb bed"], ["water", "pruning", "fresh soil", "some shade", "a new fence"]),
    "train": ("The train to %s leaves late because of %s on the line.", ["Lyon", "Porto", "Graz", "Oslo", "Ghent"], ["snow", "repairs", "a signal fault", "strong wind", "heavy traffic"]),
    "library": ("Readers of the %s asked for more %s in the reading room.", ["archive", "children's shelf", "map room", "newspaper corner", "night school"], ["light", "chairs", "quiet hours", "copies", "dictionaries"]),
}


def _pick(words: list[str], *key: Column, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.floor(draw(seed, *key) * len(words)) + 1).cast("int"))


def made_texts(spark: SparkSession, docs: int, *, sentences: int = 3, seed: int = 2026) -> DataFrame:
    """doc_id ("doc-" and its number), theme and text of so many documents; themes take turns, gaps are drawn from the document's number."""
    rows = spark.range(docs).withColumn("theme", F.element_at(F.array(*map(F.lit, THEMES)), (F.col("id") % len(THEMES) + 1).cast("int")))
    number = F.lpad(F.col("id").cast("string"), F.greatest(F.lit(3), F.length(F.col("id").cast("string"))), F.lit("0"))

    def sentence(k: int) -> Column:
        made = {t: F.format_string(frame, *(_pick(words, F.col("id"), F.lit(k), F.lit(gap), seed=seed) for gap, words in enumerate(gaps))) for t, (frame, *gaps) in THEMES.items()}
        return F.coalesce(*(F.when(F.col("theme") == t, s) for t, s in made.items()))

    return rows.select(F.concat(F.lit("doc-"), number).alias("doc_id"), "theme", F.concat_ws(" ", *map(sentence, range(sentences))).alias("text"))
