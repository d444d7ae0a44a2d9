"""Vectors against all points of a table, for any number of points.

Points that fit one block are broadcast, their size being checked. More are dealt into blocks by hash, and each pair of a block and a
slice of the vectors is a task's work: the block's points come first, then the slice's vectors stream past. Neither all
points nor a block pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateloom.functions.arrays import lists, matrix
from lateloom.functions.vectors import cosine, rounded
from lateloom.params import DimMismatch

#: Bytes of points that are broadcast, or held by a task; vectors of a slice, and those that are handled at once.
BLOCK_BYTES, SLICE_ROWS, ROWS = 128 << 20, 1 << 16, 256

#: From ids and points of a block, and vectors: the values of the first two result columns, a row for each vector.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


_ARROW = {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64()}

_sizes: WeakKeyDictionary[DataFrame, tuple[int, int]] = WeakKeyDictionary()


def size_of(points: DataFrame, column: str) -> tuple[int, int]:
    """How many points there are, and their components: counted once for a DataFrame, which never changes."""
    if points not in _sizes:
        n, dim = points.agg(F.count("*"), F.max(F.size(column))).first()
        _sizes[points] = n, dim or 0
    return _sizes[points]


def n_blocks(points: DataFrame, column: str, block_bytes: int | None = None) -> int:
    """How many blocks of at most block_bytes (BLOCK_BYTES) the points make."""
    n, dim = size_of(points, column)
    return max(1, -(-n * (dim or 1) * 8 // (BLOCK_BYTES if block_bytes is None else block_bytes)))


def one_block(points: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and the matrix, of points that n_blocks() says are one block."""
    t = points.select("centroid_id", column).orderBy("centroid_id").toArrow()
    return (t.column(0).to_numpy(), matrix(t.column(1))) if t.num_rows else (np.zeros(0, np.int32), np.zeros((0, 0)))


def _results(keys: list[pa.Array], ids: np.ndarray, c: np.ndarray, vectors: pa.Array, kernel: Kernel, names: list[str], kinds: list[pa.DataType], packed: bool = False) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(vectors), ROWS):
        x = matrix(vectors.slice(a, ROWS))
        if x.shape[1] != c.shape[1]:
            raise DimMismatch(f"vectors have {x.shape[1]} components, the points {c.shape[1]}")
        one, two = kernel(ids, c, x)
        if packed:
            yield pa.RecordBatch.from_arrays([*(k.slice(a, ROWS) for k in keys), lists(one.astype(kinds[0].to_pandas_dtype())), lists(two)], names)
            continue
        row = pa.array(np.repeat(np.arange(a, a + len(x)), one.shape[1]))
        rank = pa.array(np.tile(np.arange(1, one.shape[1] + 1, dtype=np.int32), len(x)))
        yield pa.RecordBatch.from_arrays([*(k.take(row) for k in keys), pa.array(one.ravel(), kinds[0]), pa.array(two.ravel(), kinds[1]), rank], names)


def packed(vectors: DataFrame, keys: list[str], points: DataFrame, column: str, kernel: Kernel, out: str) -> DataFrame:
    """As meet(), where the points are one block: a row for each vector, with a list for each of the two columns of out (two names and types of elements)."""
    spark = vectors.sparkSession
    kinds = [f.dataType for f in spark.createDataFrame([], out).schema]
    arrow = [_ARROW[k.typeName()] for k in kinds]
    rows = vectors.select(*keys, F.col("vec").cast("array<double>").alias("vec"))
    names = [*keys, *(c.strip().split(" ")[0] for c in out.split(","))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys) + "".join(f", {n} array<{k.simpleString()}>" for n, k in zip(names[-2:], kinds, strict=True))
    shared = spark.sparkContext.broadcast(one_block(points, column))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        for batch in batches:
            if len(batch) and len(ids):
                yield from _results([batch.column(k) for k in keys], ids, c, batch.column("vec"), kernel, names, arrow, True)

    return rows.mapInArrow(search, schema)


def meet(vectors: DataFrame, keys: list[str], points: DataFrame, column: str, kernel: Kernel, out: str, block_bytes: int | None = None) -> DataFrame:
    """keys, the two columns of out (two names and types) and rank (the place in the kernel's row), for every vector (column vec) and every block of points (centroid_id and column)."""
    spark = vectors.sparkSession
    kinds = [f.dataType for f in spark.createDataFrame([], out).schema]
    arrow = [_ARROW[k.typeName()] for k in kinds]
    rows = vectors.select(*keys, F.col("vec").cast("array<double>").alias("vec"))
    names = [*keys, *(c.strip().split(" ")[0] for c in out.split(",")), "rank"]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema if f.name in keys)}, {out}, rank int"
    blocks = n_blocks(points, column, block_bytes)
    if blocks == 1:
        shared = spark.sparkContext.broadcast(one_block(points, column))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, c = shared.value
            for batch in batches:
                if len(batch) and len(ids):
                    yield from _results([batch.column(k) for k in keys], ids, c, batch.column("vec"), kernel, names, arrow)

        return rows.mapInArrow(search, schema)
    slices = max(1, -(-vectors.count() // SLICE_ROWS))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name in keys]
    block, slice_ = F.col("block"), F.col("slice")
    left = points.select(F.pmod(F.xxhash64("centroid_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.col("centroid_id").alias("point"), *none, F.col(column).cast("array<double>").alias("vec"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(*keys), F.lit(slices)).alias("slice"), F.lit(None).cast(points.schema["centroid_id"].dataType).alias("point"), *keys, "vec")
    met = left.withColumns({"block": block.cast("int"), "slice": slice_.cast("int")}).unionByName(right.withColumns({"block": block.cast("int"), "slice": slice_.cast("int")}))
    met = met.repartition(max(blocks * slices, 1), "block", "slice").sortWithinPartitions("block", "slice", F.col("point").asc_nulls_last())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        ids, c = np.zeros(0, np.int32), np.zeros((0, 0))
        for batch in batches:
            pair = np.stack([batch.column("block").to_numpy(), batch.column("slice").to_numpy()], 1)
            point = ~np.asarray(batch.column("point").is_null())
            cuts = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]).any(1) | (point[1:] != point[:-1])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)], strict=True):
                own = batch.slice(a, b - a)
                if tuple(pair[a]) != at:
                    at, parts = tuple(pair[a]), []
                    ids = np.zeros(0, np.int32)
                if point[a]:
                    parts.append((own.column("point").to_numpy(zero_copy_only=False), matrix(own.column("vec"))))
                    continue
                if parts:
                    ids, c = (np.concatenate(x) for x in zip(*parts, strict=True))
                    parts = []
                if len(ids):
                    yield from _results([own.column(k) for k in keys], ids, c, own.column("vec"), kernel, names, arrow)

    return met.mapInArrow(stream, schema)


def cosines(vectors: DataFrame, points: DataFrame, digits: int) -> DataFrame:
    """a_id, b_id and cosine, rounded, of every point (a_id, a) with every vector (b_id, b); as vectors.cosine has it.

    Whole vectors of one length are multiplied in blocks. Pairs with a null one, one of another length or with a null component are
    taken one by one.
    """
    _, dim = size_of(points, "a")
    sound = lambda c: F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))

    def kernel(ids: np.ndarray, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.sqrt((x**2).sum(1))[:, None] * np.sqrt((c**2).sum(1))
        s = np.divide(x @ c.T, n, out=np.zeros(n.shape), where=n != 0)
        return np.broadcast_to(ids, s.shape), np.round(s, digits) + 0.0

    whole = points.where(sound("a")).select(F.col("a_id").alias("centroid_id"), "a")
    rows = vectors.where(sound("b")).select("b_id", F.col("b").alias("vec")).repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism, "b_id")  # a vector makes as many rows as there are points
    met = meet(rows, ["b_id"], whole, "a", kernel, "a_id long, cosine double").select("a_id", "b_id", "cosine")
    odd = points.where(~sound("a")).join(vectors).unionByName(points.where(sound("a")).join(vectors.where(~sound("b"))))
    return met.unionByName(odd.select("a_id", "b_id", rounded(cosine(F.col("a"), F.col("b")), digits).alias("cosine")))
