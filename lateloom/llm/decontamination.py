"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of n shingles is contained in a document at threshold t if at least need = ceil(t n) of them occur there; then at most
n - need are missing, and of the n - need + 1 shingles of least hash (its MinHash sketch) at least one occurs. Items are
partitioned by size, and every item of a partition keeps a sketch as long as its largest size needs, so that a document of any
length finds all its items by looking up its own shingles: no candidate is lost, however long it is. Candidates are verified by
the items' whole shingle sets, and then by the words themselves.

Documents are read once and never shuffled. What is broadcast are the items' hashes, in blocks of at most BLOCK_SHINGLES.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._shared import MARKS, held, lists, materialize, shingles, utf8, words

#: Shingles of the items that one pass over the documents looks for, at most: 8 bytes each, and 2 MB of bits.
BLOCK_SHINGLES = 2_000_000
_BITS = 24
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


def _grams(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    found = _WORD.findall(text)
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def needed(n: int, percent: int) -> int:
    return max(1, -(-percent * n // 100))


def sketch_size(n: int, percent: int) -> int:
    """Of the partition of sizes from a power of two up to the next."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest - needed(largest, percent) + 1)


@dataclass
class Index:
    """Of the items of one block whose shingles have the same number of words."""

    size: int
    ids: list
    texts: list[bytes]
    sets: list[np.ndarray]
    percent: int

    def __post_init__(self) -> None:
        sketches = [s[: sketch_size(len(s), self.percent)] for s in self.sets]
        hashes = np.concatenate(sketches)
        items = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items = hashes[order], items[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, found: np.ndarray) -> np.ndarray:
        """Numbers of the shingles in found that are in a sketch."""
        at = np.flatnonzero(self.bits[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
        place = np.searchsorted(self.hashes, found[at])
        place[place == len(self.hashes)] = 0
        return at[self.hashes[place] == found[at]]

    def items_of(self, hashes: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
        return np.unique(np.concatenate([self.items[a:b] for a, b in zip(left, right, strict=True)]))


def item_sets(items: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """key, lower-cased text, words of a shingle, and distinct shingle hashes ascending of every item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _lower(batch.column(1))
            sizes, sets = [], []
            for _, _, data, off in utf8(low, limit=-1):
                h, at = words(data, off, MARKS)
                sizes.append(min(size, len(h)))
                sets.append(np.unique(shingles(h, at, max(1, sizes[-1]))[0]).view(np.int64))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            at = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), low, pa.array(sizes, pa.int32()), lists(flat, at, pa.int64())], ["key", "text", "size", "hashes"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, text string, size int, hashes array<long>").where("size > 0")


def _blocks(items: DataFrame, size: int, key: str, text: str) -> Iterator[Broadcast]:
    """The items, broadcast in blocks of about BLOCK_SHINGLES shingles (an item is never parted)."""
    sets = materialize(item_sets(items, size, key, text))
    total = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    numbered = sets.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)))
    for block in range(blocks):
        own = numbered.where(F.col("block") == block).select("key", "text", "size", "hashes").toArrow()
        yield items.sparkSession.sparkContext.broadcast(own)


def find_contained(
    docs: DataFrame, items: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """key, item_key, n_shingles, n_shared and containment of every pair of a row of docs and an item of which it has at least percent of the shingles.

    Words are runs of letters and digits of ASCII and of all characters beyond it, in lower case. An item with fewer words than size
    is one shingle of all its words. Null and empty items and documents are in no pair. Repeated rows give repeated pairs, and rows
    with the same key pairs of their own. Further columns are not read.
    """
    doc_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = []
    for shared in _blocks(items, size, item_key, item_text):

        def search(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            indexes = held("contained", shared.value, lambda: _indexes(shared.value, percent))
            for batch in batches:
                pairs = [x for i, j, data, off in utf8(_lower(batch.column(1))) for x in _search(indexes, i, data, off)]
                keys = batch.column(0).take(pa.array([p[0] for p in pairs], pa.int64()))
                ids = shared.value.column("key").combine_chunks().take(pa.array([p[1] for p in pairs], pa.int64())) if pairs else pa.array([], shared.value.schema.field("key").type)
                n = [pa.array([p[k] for p in pairs], pa.int64()) for k in (2, 3)]
                share = pa.array([p[3] / p[2] for p in pairs], pa.float64())
                yield pa.RecordBatch.from_arrays([keys, ids, *n, share], ["key", "item", "n_shingles", "n_shared", "containment"])

        found.append(rows.mapInArrow(search, f"key {doc_kind}, item {item_kind}, n_shingles long, n_shared long, containment double"))
    return reduce(DataFrame.unionAll, found).withColumnsRenamed({"key": key, "item": item_key})


def without_contained(docs: DataFrame, items: DataFrame, *, size: int = 5, percent: int = 80, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that are in no pair of find_contained: decided row by row, whatever their keys, and with all their columns."""
    out = docs
    for shared in _blocks(items, size, item_key, item_text):

        def clean(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            indexes = held("contained", shared.value, lambda: _indexes(shared.value, percent))
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                own = batch.column(batch.num_columns - 1).cast(pa.string())
                keep[[x[0] for i, j, data, off in utf8(_lower(own)) for x in _search(indexes, i, data, off)]] = False
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep))

        names = [f"c{k}" for k in range(len(docs.columns))]
        numbered = out.toDF(*names).withColumn("text", F.col(names[docs.columns.index(text)]).cast("string"))
        kept = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
        out = numbered.mapInArrow(clean, kept).toDF(*docs.columns)
    return out


def _indexes(own: pa.Table, percent: int) -> list[Index]:
    sizes = own.column("size").to_numpy()
    texts, hashes = own.column("text").to_pylist(), own.column("hashes").to_pylist()
    return [
        Index(int(s), at.tolist(), [texts[i].encode() for i in at], [np.sort(np.array(hashes[i], np.int64).view(np.uint64)) for i in at], percent)
        for s in np.unique(sizes)
        for at in [np.flatnonzero(sizes == s)]
    ]


def _search(indexes: list[Index], first: int, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, item's row, its shingles and those found, for the texts laid end to end."""
    h, at = words(data, off, MARKS)
    for index in indexes:
        grams, begin = shingles(h, at, index.size)
        hits = index.candidates(grams)
        docs = np.searchsorted(begin, hits, "right") - 1
        for d in np.unique(docs):
            own = np.unique(grams[begin[d] : begin[d + 1]])
            doc_grams = None
            for i in index.items_of(np.unique(grams[hits[docs == d]])):
                s = index.sets[i]
                if np.isin(s, own, assume_unique=True).sum() < needed(len(s), index.percent):
                    continue
                doc_grams = doc_grams if doc_grams is not None else _grams(data[off[d] : off[d + 1]].tobytes(), index.size)
                item_grams = _grams(index.texts[i], index.size)
                n = len(item_grams & doc_grams)
                if n >= needed(len(item_grams), index.percent):
                    yield first + int(d), index.ids[i], len(item_grams), n
