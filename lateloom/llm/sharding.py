"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

With one more shard, a row either stays or goes to the new shard, so about one row in n + 1 moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._shared import materialize

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, from 0 to shards - 1."""
    if shards < 1:
        raise ValueError("there must be a shard")
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    after = np.zeros(len(key), np.int64)
    while len(todo):
        at[todo] = after
        key[todo] = key[todo] * _STEP + np.uint64(1)
        after = np.floor((at[todo] + 1) * (float(1 << 31) / ((key[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        more = after < shards
        todo, after = todo[more], after[more]
    return at


def shard_documents(docs: DataFrame, shards: int = 8, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard for every row of docs.

    size is the text's UTF-8 bytes plus 1 (null: 1, with the CRC of nothing). Slots of a shard are gapless from 0.
    A null key counts as 0; one that is no integer counts as a 64-bit hash of it. Repeated rows go to the same shard and have slots of
    their own. Further columns are not read.

    Only 40 bytes a row are shuffled. A shard's rows are numbered inside many buckets, which rows of one key share evenly,
    and the buckets' counts (a fixed number of rows) give where each begins; so no task holds a whole shard or a hot key.
    """
    spark = docs.sparkSession
    buckets = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("jump").to_numpy()
            found = [pa.array(jump_hash(k, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "size", "text_crc32")), *found], ["key", "size", "text_crc32", "shard", "grown_shard"])

    kind = docs.schema[key].dataType
    jump = F.col(key).cast("long") if isinstance(kind, IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(jump, F.lit(0).cast("long")).alias("jump"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    placed = rows.mapInArrow(place, f"key {kind.simpleString()}, size long, text_crc32 long, shard int, grown_shard int")  # texts stay in the JVM
    placed = materialize(placed.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")))
    ranked = placed.withColumn("n", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("key", "text_crc32")))
    ends = ranked.groupBy("shard", "bucket").agg(F.max("n").alias("rows"))
    begins = ends.select("shard", "bucket", (F.sum("rows").over(W.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("begin"))
    joined = ranked.join(F.broadcast(begins), ["shard", "bucket"])  # shards times buckets rows
    return joined.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("begin") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard"
    )
