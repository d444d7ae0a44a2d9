"""Statistics of token groups: frequency, spread, tier and weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(tokens: DataFrame, dense: bool = False) -> DataFrame:
    """n_j of every token id present; dense: of every id from 0 to the greatest."""
    counts = tokens.groupBy("token_id").agg(F.count("*").alias("n_j"))
    if not dense:
        return counts
    last = tokens.agg(F.max("token_id")).first()[0]
    ids = tokens.sparkSession.range(0 if last is None else last + 1).select(F.col("id").alias("token_id"))
    return ids.join(counts, "token_id", "left").select("token_id", F.coalesce("n_j", F.lit(0).cast("long")).alias("n_j"))


def spread(tokens: DataFrame) -> DataFrame:
    """n_j and s_j, the mean squared distance from the token's mean. Components are aggregated before they are shuffled, so a frequent token is no hot task."""
    parts = tokens.select("token_id", F.posexplode(F.col("vec").cast("array<double>")).alias("d", "x"))
    by_component = parts.groupBy("token_id", "d").agg(F.count("*").alias("n"), F.var_pop("x").alias("v"))
    return by_component.groupBy("token_id").agg(F.max("n").alias("n_j"), F.sum("v").alias("s_j"))


def tier(n: Column, mu: int, tau: int) -> Column:
    return F.when(n == 0, "empty").when(n < mu, "micro").when(n < tau, "small").otherwise("active")


def damped_weight(n: Column, s: Column) -> Column:
    return F.sqrt(n.cast("double")) * s


def alias_share(tokens: DataFrame) -> DataFrame:
    """Distinct token ids, and the share of them that occur at least twice."""
    return frequency(tokens).agg(F.count("*").alias("n_tokens"), (F.count_if(F.col("n_j") >= 2) / F.count("*")).alias("share"))
