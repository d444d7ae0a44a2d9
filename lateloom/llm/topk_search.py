"""Exact top-k inner-product search over norm buckets.

Vectors are dealt by length into cells and, inside a cell, into buckets of like length. A query's least useful score t, found
on the longest vectors of all and raised as its list fills, gives each bucket the local cosine threshold t / (|q| * longest):
above 1, the bucket is passed over; where it is high, coordinates are pruned: a vector whose components at the query's
focus coordinates lie outside of the range that this cosine allows is dropped; where it is low, vectors are pruned
by length alone. What remains is verified by products of integers. All bounds are widened by a rounding margin, so results are exact.

A cell gets its buckets once, and a block of queries as one packed row if its longest vector can reach any of the block's least
scores: cells are ordered by length, so these are the first so many. Only packed blocks are shuffled, and the lists of a
block meet in one place, k entries for each query and cell at most; so neither many equal vectors nor many queries fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: Vectors of a bucket and of a cell, queries of a block.
BUCKET, CELL, BLOCK = 2048, 1 << 16, 1024
#: Local cosine threshold from which coordinates are pruned; focus coordinates.
COSINE, FOCUS = 0.85, 4
#: Scores are exact below this.
_EXACT = float(1 << 53)


@dataclass
class _Pack:
    """Vectors laid side by side: ids ascending, whole components (doubles, where they are wide), lengths."""

    ids: np.ndarray
    x: np.ndarray
    norms: np.ndarray

    def packed(self) -> tuple[bytes, bytes, int]:
        for kind in (np.int8, np.int16, np.int32):
            info = np.iinfo(kind)
            if not self.x.size or (self.x.min() >= info.min and self.x.max() <= info.max):
                return self.ids.tobytes(), self.x.astype(kind).tobytes(), np.dtype(kind).itemsize
        return self.ids.tobytes(), self.x.astype(np.float64).tobytes(), 8

    @classmethod
    def of(cls, ids: bytes, x: bytes, width: int) -> _Pack:
        got = np.frombuffer(ids, np.int64)
        v = np.frombuffer(x, f"<i{width}" if width < 8 else "<f8").reshape(len(got), -1)
        return cls(got, v, _lengths(v))

    def numbers(self, other: _Pack) -> np.dtype:
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.float64(self.norms.max(initial=0)) * np.float64(other.norms.max(initial=0))
        return np.dtype(np.float32) if most < 1 << 23 else np.dtype(np.float64) if most < _EXACT else np.dtype(object)


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # an endless length prunes nothing
        return np.sqrt((x.astype(np.float64) ** 2).sum(-1))


def _wide(packs: list[_Pack]) -> int:
    return max((p.x.shape[1] for p in packs), default=0)


def _pad(x: np.ndarray, n: int) -> np.ndarray:
    return x if x.shape[1] == n else np.pad(x, ((0, 0), (0, n - x.shape[1])))


def _floats(score: np.ndarray) -> np.ndarray:
    """In order, but not always distinct."""
    if score.dtype != object:
        return score.astype(np.float64)
    most = int(np.finfo(np.float64).max)
    return np.array([float(min(max(v, -most), most)) for v in score.ravel()]).reshape(score.shape)


def _bytes(score: np.ndarray) -> bytes:
    """Whole numbers of any size: the width of each, and then all."""
    if score.dtype != object:
        return b"\x08\x00" + score.astype("<i8").tobytes()
    width = max([8, *(v.bit_length() // 8 + 1 for v in score.tolist())])
    return width.to_bytes(2, "little") + b"".join(v.to_bytes(width, "little", signed=True) for v in score.tolist())


def _numbers(raw: bytes) -> np.ndarray:
    width = int.from_bytes(raw[:2], "little")
    if width == 8:
        return np.frombuffer(raw, "<i8", offset=2)
    return np.array([int.from_bytes(raw[i : i + width], "little", signed=True) for i in range(2, len(raw), width)], object)


def _longs(score: np.ndarray) -> np.ndarray:
    info = np.iinfo(np.int64)
    return score if score.dtype != object else np.array([min(max(v, info.min), info.max) for v in score.tolist()], np.int64)


class Lists:
    """The k best (score, then smaller id) of each query of a block so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        if score.dtype == object:
            order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), np.int64)
        else:
            order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.id, self.score = row[keep], ids[keep], score[keep]
        last = rank == self.k - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], _floats(score[last]))


_whole = np.frompyfunc(int, 1, 1)


def _products(q: np.ndarray, c: np.ndarray, kind: np.dtype) -> np.ndarray:
    if kind == object:
        return _whole(q) @ _whole(c).T
    s = q.astype(kind) @ c.astype(kind).T
    return np.rint(s, out=s)


def search_bucket(lists: Lists, queries: _Pack, bucket: _Pack, focus: np.ndarray) -> None:
    """Adds to lists what the bucket (its ids ascending) has for the queries. focus: the coordinates where each query is largest."""
    longest = float(bucket.norms.max(initial=0))
    with np.errstate(over="ignore", invalid="ignore"):
        reach = queries.norms * longest
    live = np.flatnonzero(~(lists.least > reach * (1 + 1e-9)))
    if not len(live) or not len(bucket.ids):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach[live] > 0, lists.least[live] / reach[live], -1.0)
    kind = queries.numbers(bucket)
    for i in live[local >= COSINE]:
        _by_coordinates(lists, queries, bucket, int(i), focus[i], kind)
    rest = live[~(local >= COSINE)]
    if len(rest):
        _by_length(lists, queries, bucket, rest, kind)


def _by_coordinates(lists: Lists, queries: _Pack, bucket: _Pack, i: int, focus: np.ndarray, kind: np.dtype) -> None:
    q = queries.x[i].astype(np.float64) / queries.norms[i]
    at = np.flatnonzero(bucket.norms * queries.norms[i] * (1 + 1e-9) >= lists.least[i])
    for f in focus:
        norms = np.maximum(bucket.norms[at], 1e-300)
        t = np.minimum(lists.least[i] / (queries.norms[i] * norms), 1.0)  # each vector's own threshold
        slack = np.sqrt(np.maximum((1 - t * t) * (1 - q[f] * q[f]), 0)) + 1e-7
        off = bucket.x[at, f] / norms - t * q[f]
        beyond = (np.abs(q[f]) + 1e-7 >= t) & (off * q[f] >= 0)  # the axis itself is near enough to the query: no end on that side
        at = at[(np.abs(off) <= slack) | beyond]
    if len(at):
        _keep(lists, np.array([i]), bucket.ids[at], _products(queries.x[i : i + 1], bucket.x[at], kind), queries.ids[i : i + 1])


def _by_length(lists: Lists, queries: _Pack, bucket: _Pack, rows: np.ndarray, kind: np.dtype) -> None:
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(queries.norms[rows] > 0, lists.least[rows] / queries.norms[rows], -np.inf)
    at = np.flatnonzero(~(bucket.norms * (1 + 1e-9) < need.min()))
    if len(at):
        _keep(lists, rows, bucket.ids[at], _products(queries.x[rows], bucket.x[at], kind), queries.ids[rows])


def _keep(lists: Lists, rows: np.ndarray, ids: np.ndarray, s: np.ndarray, own: np.ndarray) -> None:
    hit = _floats(s) >= lists.least[rows][:, None] if s.dtype == object else s >= lists.least[rows][:, None]
    hit &= ids[None, :] != own[:, None]
    if s.dtype != object and hit.sum() > 8 * lists.k * len(rows):  # many ties, or lists not yet full: the k first of each row suffice
        n = s.shape[1]
        order = np.where(hit, s, -np.inf)
        if n > lists.k:
            kth = -np.partition(-order, lists.k - 1, axis=1)[:, lists.k - 1 : lists.k]
            above = order > kth
            tied = (order == kth) & hit
            tied &= np.cumsum(tied, 1) <= lists.k - above.sum(1, keepdims=True)  # ids ascend
            hit = (above | tied) & hit
    r, c = np.nonzero(hit)
    lists.add(rows[r], ids[c], s[r, c] if s.dtype == object else s[r, c].astype(np.int64))


def _focus(queries: _Pack) -> np.ndarray:
    n = min(FOCUS, queries.x.shape[1])
    return np.argsort(-np.abs(queries.x.astype(np.float64)), 1, kind="stable")[:, :n]


def _vectors(batches: Iterator[pa.RecordBatch], key: str, vector: str, scale: float) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        ids, rows = [], []
        for i, v in zip(batch.column(key).to_pylist(), batch.column(vector), strict=True):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if np.isfinite(x).all():
                ids.append(i)
                rows.append(x)
        if ids:
            yield np.array(ids, np.int64), rows


def _stack(rows: list[np.ndarray]) -> np.ndarray:
    if len({len(r) for r in rows}) == 1:
        return np.stack(rows)
    x = np.zeros((len(rows), max(map(len, rows))))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x


_PACKED = "cell int, kind int, seq long, n int, longest double, ids binary, x binary, width int, least binary"
_NAMES = ["cell", "kind", "seq", "n", "longest", "ids", "x", "width", "least"]


def _row(cell: int, kind: int, seq: int, pack: _Pack, least: bytes = b"") -> pa.RecordBatch:
    ids, x, width = pack.packed()
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    values = (cell, kind, seq, len(pack.ids), float(_lengths(pack.x).max(initial=0)), ids, x, width, least)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], _NAMES)


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose key is divisible by every, the k rows of other keys with the greatest inner product.

    Components are floor(scale * x), in doubles. Rows with a null key, a null vector, or components that are null, or not finite after
    that, take no part. Products are whole numbers of any size and order the result; a score beyond 64 bits shows as the nearest
    long. A shorter vector counts as ending in zeros. Rows with the query's own key are no candidates.
    Repeated rows are candidates, or queries, each. Fewer than k candidates are all returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _vectors(batches, "key", "vector", scale):
            norms = [float(_lengths(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(norms, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], ["key", "norm", "x"])

    ready = materialize(own.mapInArrow(lengths, "key long, norm double, x array<double>"))
    n = ready.count()
    cells = max(1, -(-n // CELL), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (2 * BUCKET))))

    def pack(kind: int, size: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, seq = TaskContext.get().partitionId(), 0
            ids, rows = np.zeros(0, np.int64), []

            def flush(m: int) -> pa.RecordBatch:
                nonlocal ids, rows, seq
                order = np.argsort(ids[:m], kind="stable")
                x = _stack([rows[i] for i in order])
                out = _row(cell, kind, (cell << 32) + seq, _Pack(ids[:m][order], x, np.zeros(0)))
                ids, rows, seq = ids[m:], rows[m:], seq + 1
                return out

            for batch in batches:
                ids = np.concatenate([ids, batch.column(0).to_numpy()])
                rows += [np.array(r, np.float64) for r in batch.column(1).to_numpy(zero_copy_only=False)]
                while len(ids) >= size:
                    yield flush(size)
            if len(ids):
                yield flush(len(ids))

        return run

    by_length = ready.repartitionByRange(cells, F.desc("norm"), "key").sortWithinPartitions(F.desc("norm"), "key")
    buckets = materialize(by_length.select("key", "x").mapInArrow(pack(0, BUCKET), _PACKED))
    queries = ready.where(F.col("key") % every == 0).select("key", "x").mapInArrow(pack(1, BLOCK), _PACKED)
    first_bucket = [r.asDict() for r in buckets.orderBy("cell", "seq").limit(1).collect()]  # one bucket
    # 8 bytes for each CELL vectors; ranges are by falling length
    ends = [tuple(r) for r in buckets.groupBy("cell").agg(F.max("longest")).collect()]
    seed = spark.sparkContext.broadcast((first_bucket, ends))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gives each block of queries its least useful scores."""
        for batch in batches:
            for r in batch.to_pylist():
                block = _Pack.of(r["ids"], r["x"], r["width"])
                lists = Lists(len(block.ids), k)
                for s in seed.value[0]:
                    bucket = _Pack.of(s["ids"], s["x"], s["width"])
                    wide = _wide([block, bucket])
                    block.x, bucket.x = _pad(block.x, wide), _pad(bucket.x, wide)
                    search_bucket(lists, block, bucket, _focus(block))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(block.norms > 0, lists.least / block.norms, -np.inf)
                least = np.where(np.isnan(need), -np.inf, need).min(initial=np.inf)
                last = max(cell for cell, longest in seed.value[1] if not longest * (1 + 1e-9) < least)
                yield _row(last, 1, r["seq"], block, lists.least.tobytes())

    blocks = materialize(queries.mapInArrow(first, _PACKED))  # cell: the last that a block must meet
    dealt = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cell"))))
    met = buckets.unionByName(dealt.select(*_NAMES)).repartition(cells, "cell").sortWithinPartitions("cell", "kind", "seq")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != at:
                    at, held = r["cell"], []
                pack = _Pack.of(r["ids"], r["x"], r["width"])
                if r["kind"] == 0:
                    held.append(pack)
                    continue
                lists = Lists(len(pack.ids), k)
                lists.least = np.frombuffer(r["least"]).copy()
                for bucket in held:
                    wide = _wide([pack, bucket])
                    pack.x, bucket.x = _pad(pack.x, wide), _pad(bucket.x, wide)
                    search_bucket(lists, pack, bucket, _focus(pack))
                out = (r["seq"], r["ids"], lists.row.tobytes(), lists.id.tobytes(), _bytes(lists.score))
                yield pa.RecordBatch.from_arrays([pa.array([out[0]], pa.int64()), *(pa.array([b], pa.binary()) for b in out[1:])], ["seq", "ids", "row", "found", "score"])

    partial = met.mapInArrow(search, "seq long, ids binary, row binary, found binary, score binary")
    gathered = partial.repartition("seq").sortWithinPartitions("seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, lists = None, np.zeros(0, np.int64), Lists(0, k)

        def result() -> pa.RecordBatch:
            rank = np.arange(len(lists.row)) - np.searchsorted(lists.row, lists.row) + 1
            return pa.RecordBatch.from_arrays([pa.array(ids[lists.row]), pa.array(rank.astype(np.int32)), pa.array(lists.id), pa.array(_longs(lists.score))], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["seq"] != at:
                    if at is not None:
                        yield result()
                    at, ids = r["seq"], np.frombuffer(r["ids"], np.int64)
                    lists = Lists(len(ids), k)
                lists.add(*(np.frombuffer(r[c], np.int64) for c in ("row", "found")), _numbers(r["score"]))
        if at is not None:
            yield result()

    return gathered.mapInArrow(merge, "query_id long, rank int, vec_id long, score long")
