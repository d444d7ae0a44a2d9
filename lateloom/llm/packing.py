"""Best-fit packing with certified bounds.

Documents become token ids, and pieces of at most one sequence. Pieces are dealt into packing partitions by hash; each
partition packs its pieces by best-fit decreasing and certifies its count of bins by the lower bound that dual feasible functions
give for its pieces. Partitions with a gap meet in fewer partitions, where their pieces (later on those of bins that have room) are
packed anew and certified again, round by round. Where no partition has a gap, but all together have more bins than the bound over
all pieces (each rounds up by itself), the certified ones exchange what has room too, until that bound is met or one partition is left.

Only lengths matter for packing, so a partition is packed as a histogram of at most one entry for each length: best-fit
decreasing places equal pieces together, and its result is a list of bin patterns with multiplicities. Patterns become
places, and places meet pieces on (partition, length, rank). Token ids never leave the worker that made them.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import held, materialize, temporary

#: Pieces of a packing partition, about.
PART_PIECES = 1 << 16
#: Entries of a worker's cache of encoded words, which then starts anew, and the longest word it keeps.
CACHE_ENTRIES, LONGEST = 200_000, 64
#: Partitions that meet in one when bins are exchanged.
MEET = 16

#: How the byte-level pre-tokenizer parts a text (fixed by the tokenizer).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space around a space: the words at both sides depend on each other.
_TIED = re.compile(r"\s (?:\s|$)")
#: Characters on whose class all libraries may not agree; the tokenizer itself encodes a text that has them.
_RARE = re.compile("[^\x00-\x1b\x20-\x84\x86-῿‐-‧‰-⁞₠-₿、-퟿豈-﷿]")


class Encoder(dict):
    """Token ids of whole texts, as little-endian bytes, equal to those of the tokenizers library for the file at path.

    A byte-level file whose ids follow its merges is served word by word from a cache, since a pre-token never goes on
    past a space; for any other file, and for rare characters, the library itself encodes.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.fast = self._fast(json.load(f))

    def _fast(self, file: dict) -> Callable[[str], list[int]] | None:
        import tiktoken

        pre, model, added = file["pre_tokenizer"] or {}, file["model"], file["added_tokens"]
        vocab = model.get("vocab", {})
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or file["normalizer"] or model.get("ignore_merges"):
            return None
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            return None
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(vocab.get(w) != 256 + i for i, w in enumerate(merged)):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(shown[c] for c in w): i for w, i in vocab.items() if w not in self.special}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        return tiktoken.Encoding("from_file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        """Of the word after a space."""
        ids = array("I", self.fast(" " + word)).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or _RARE.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if self.parts and self.parts.search(text):
            return b"".join(self.special.get(x) or self._plain(x) for x in self.parts.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _TIED.search(text):
            return array("I", self.fast(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.fast(first)).tobytes() + b"".join(map(self.__getitem__, rest))


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: all but the first have most."""
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def token_pieces(docs: DataFrame, path: str, *, most: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids_crc32 of every piece of every document, its ids closed by end_id. A null text is empty: one piece, of end_id."""
    end = array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held("encoder", path, lambda: Encoder(path))
        for batch in batches:
            row, piece, start, length, crc = array("q"), array("i"), array("q"), array("q"), array("q")
            for r, t in enumerate(batch.column(1).fill_null("")):
                raw = encode.ids(t.as_py()) + end
                for k, (at, n) in enumerate(cut(len(raw) // 4, most)):
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
            keys = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(pieces, f"key {kind}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((partition the piece is from, length), ...) and how many bins are so


def best_fit_decreasing(counts: dict[tuple[int, int], int], most: int) -> list[Pattern]:
    """Packs counts[from, length] pieces into bins of most. The patterns of the bins, with multiplicities."""
    open_bins: dict[int, list[Pattern]] = defaultdict(list)  # by room
    rooms: list[int] = []  # those with bins, ascending
    done: list[Pattern] = []

    def put(room: int, items: tuple[tuple[int, int], ...], n: int) -> None:
        if room == 0:
            done.append((items, n))
        else:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append((items, n))

    for (origin, size), left in sorted(counts.items(), key=lambda x: (-x[0][1], x[0][0])):
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = min(most // size, left)  # an opened bin is then the tightest that fits
                put(most - each * size, ((origin, size),) * each, left // each)
                left %= each
                continue
            room = rooms[i]
            items, n = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(i)
            each = min(room // size, left)
            used = min(n, left // each)
            if used < n:
                put(room, items, n - used)
            put(room - each * size, items + ((origin, size),) * each, used)
            left -= each * used
    return done + [p for room in rooms for p in open_bins[room]]


def lower_bound(counts: Counter[int], most: int) -> int:
    """Bins of most that pieces of these lengths need at least: the best of three families of dual feasible functions."""
    if not counts:
        return 0
    size = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in size.tolist()], np.int64)
    best = -(-int(size @ n) // most)
    for a in range(1, most // 2 + 1):  # pieces under a vanish, and those over most - a count as whole bins
        f = np.where(size > most - a, most, np.where(size >= a, size, 0))
        best = max(best, -(-int(f @ n) // most))
    for k in range(1, 101):  # stairs: (k + 1) x / most, rounded down where not whole, in k-ths
        x = (k + 1) * size
        f = np.where(x % most == 0, x * k, (x // most) * most * (k + 1))
        best = max(best, -(-int(f @ n) // (most * k * (k + 1))))
    return best


_PLAN = "part long, bins long, origins array<long>, sizes array<long>, used long, gap long"


def certified(patterns: Iterable[Pattern], most: int) -> int:
    """How many bins more than their lower bound the patterns have: 0 is a proof that no packing has fewer."""
    counts: Counter[int] = Counter()
    bins = 0
    for items, n in patterns:
        bins += n
        for _, size in items:
            counts[size] += n
    return bins - lower_bound(counts, most)


def _frame(part: int, patterns: list[Pattern], most: int) -> pd.DataFrame:
    gap = certified(patterns, most)
    rows = [(part, n, [o for o, _ in items], [s for _, s in items], sum(s for _, s in items), gap) for items, n in patterns]
    return pd.DataFrame(rows, columns=["part", "bins", "origins", "sizes", "used", "gap"])


def _gathered(pdf: pd.DataFrame) -> dict[tuple[int, int], int]:
    counts: Counter[tuple[int, int]] = Counter()
    for n, origins, sizes in zip(pdf["bins"], pdf["origins"], pdf["sizes"], strict=True):
        for x in zip(map(int, origins), map(int, sizes), strict=True):
            counts[x] += int(n)
    return dict(counts)


def _plan(pieces: DataFrame, parts: int, most: int) -> DataFrame:
    """The bins' patterns, for pieces (part, length) in parts partitions."""
    histogram = pieces.groupBy("part", "length").count()

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        return _frame(part, best_fit_decreasing({(part, int(s)): int(n) for s, n in zip(pdf["length"], pdf["count"], strict=True)}, most), most)

    plan = materialize(histogram.groupBy("part").applyInPandas(first, _PLAN))
    lengths = Counter({int(r["length"]): int(r["n"]) for r in histogram.groupBy("length").agg(F.sum("count").alias("n")).collect()})  # under most rows
    bound = lower_bound(lengths, most)
    settled, full, waits = [], 0, False
    while full + (plan.agg(F.sum("bins")).first()[0] or 0) > bound and (parts > 1 or waits):
        waits = parts > 1 and plan.where("gap > 0").limit(1).count() > 0
        exchanges = F.col("gap") > 0 if waits else F.lit(True)  # certified partitions wait as long as others have a gap
        # at first, whole partitions meet: at most MEET entries for each length; later, bins without room stay
        stay = (F.col("used") == most) & ~exchanges if not settled else F.col("used") == most
        kept = materialize(plan.where(stay))
        settled.append(kept)
        full += kept.agg(F.sum("bins")).first()[0] or 0

        def again(pdf: pd.DataFrame) -> pd.DataFrame:
            new = best_fit_decreasing(_gathered(pdf), most)
            old = [(tuple(zip(map(int, o), map(int, s), strict=True)), int(n)) for n, o, s in zip(pdf["bins"], pdf["origins"], pdf["sizes"], strict=True)]
            return _frame(int(pdf["part"].iloc[0]) // MEET, min(new, old, key=lambda p: sum(n for _, n in p)), most)

        room = plan.where(~stay)
        met = F.floor(F.col("part") / MEET)
        plan = materialize(room.where(exchanges).groupBy(met).applyInPandas(again, _PLAN).unionByName(room.where(~exchanges).withColumn("part", met)))
        parts = -(-parts // MEET)
    for kept in settled:
        plan = plan.unionByName(kept)
    return plan


def pack(pieces: DataFrame, *, most: int = 1024, part_pieces: int = PART_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (with a length from 1 to most each). Sequences hold at most most, without gaps."""
    pieces = materialize(pieces)
    parts = max(1, -(-pieces.count() // part_pieces))
    whole = pieces.where(F.col("length") == most)
    pieces = materialize(pieces.where(F.col("length") != most).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))))
    with temporary() as result:
        plan = result(_plan(pieces, parts, most))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_no = TaskContext.get().partitionId() << 40  # the plan is a stored table: a task that runs again has the same rows
        for batch in batches:
            for bins, origins, sizes in zip(*(batch.column(c).to_pylist() for c in ("bins", "origins", "sizes")), strict=True):
                offsets = np.cumsum([0, *sizes[:-1]])
                for at in range(0, bins, 1024):  # a frequent pattern has many bins
                    n = min(1024, bins - at)
                    columns = [np.repeat(np.arange(bin_no, bin_no + n), len(sizes)), *(np.tile(np.array(x, np.int64), n) for x in (origins, sizes, offsets))]
                    bin_no += n
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sequence_id", "part", "length", "offset"])

    place = plan.select("bins", "origins", "sizes").mapInArrow(places, "sequence_id long, part long, length long, offset long")
    place = place.withColumn("rank", F.row_number().over(W.partitionBy("part", "length").orderBy("sequence_id", "offset")))
    ranked = pieces.withColumn("rank", F.row_number().over(W.partitionBy("part", "length").orderBy("key", "piece", "ids_crc32")))
    # Spark takes a plan's size for that of its places, and would broadcast them
    packed = ranked.join(place.hint("merge"), ["part", "length", "rank"])
    alone = whole.withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    names = [c for c in whole.columns if c not in ("sequence_id", "offset")]
    return packed.select(*names, "sequence_id", "offset").unionByName(alone.select(*names, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str, *, most: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs.

    Empty and null texts are one piece of the closing id. Rows with the same key, or none, are documents of their own.
    An empty table gives no rows. Further columns are not read.
    """
    packed = pack(token_pieces(docs, path, most=most, end_id=end_id, key=key, text=text), most=most)
    return packed.withColumnRenamed("key", key)
