"""Seeded samples that are the same for every partitioning: each row draws its own number from its content, not from a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MORE
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def content(x: np.ndarray) -> np.ndarray:
    """64 bits of each row of doubles; equal rows (0 and -0 are equal) have equal ones."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64).reshape(x.shape)
    h = np.zeros(len(x), np.uint64)
    for c in range(bits.shape[1]):
        h = mixed(h + _ODD + bits[:, c])
    return h


def uniform(keys: np.ndarray, seed: int, step: int = 0) -> np.ndarray:
    """A number in (0, 1) for each key."""
    salt = mixed(np.array([seed * 0x10001 + step & 0xFFFFFFFFFFFFFFFF], np.uint64) + _ODD)
    return ((mixed(keys ^ salt) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def exponential(keys: np.ndarray, weights: np.ndarray, seed: int, step: int = 0) -> np.ndarray:
    """Keys of which the k least are a sample of k rows without replacement, by weight. Infinite where a weight is 0."""
    with np.errstate(divide="ignore"):
        return np.where(weights > 0, -np.log(uniform(keys, seed, step)) / weights, np.inf)


def draw(seed: int, *key: Column) -> Column:
    """A number in (0, 1) for each row by its key columns, by MD5 so that any engine gives the same: 52 bits."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sample(rows: DataFrame, k: int, weight: Column, key: list[str], *, seed: int, by: list[str] | None = None) -> DataFrame:
    """k rows of each group (by; else of all) without replacement, by weight, with order: the sample's first k' rows are a sample of k'.

    key must tell rows apart. Rows with a weight that is null, not finite or not positive are never drawn. A group's partitions keep
    k rows each before they meet (WindowGroupLimit), so no group meets as a whole.
    """
    by = by or []
    own = rows.withColumn("sample_key", F.when((weight > 0) & (weight < float("inf")), -F.log(draw(seed, *map(F.col, key))) / weight)).where("sample_key IS NOT NULL")
    order = [F.asc("sample_key"), *map(F.asc, key)]
    if not by:
        top = own.orderBy(*order).limit(k)
        return top.withColumn("order", F.row_number().over(W.orderBy(*order)))  # k rows
    return own.withColumn("order", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("order") <= k)
