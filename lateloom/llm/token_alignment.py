"""Alignment of two tokenizers: groups of tokens that cover the same bytes, pairs of tokens that end together, and how usual a pair is.

Per text, the tokens of B form a static interval index: their begins and ends, sorted. For each token of A, bisection finds the run
of B's tokens that it overlaps. A gap between tokens of B that no token of A spans parts two groups.

Neither tokenizer here has tokens that go on past a single space, so the groups of a word with the space before it are the same
in every text: a worker's cache holds them, and only words that it misses are encoded and aligned. Where that isn't certain (other
files, several spaces in a row, rare characters) the whole text is.

Texts are read once. Each document's pairs go to a stored table as numbers; their corpus-wide counts are summed from it, each task's
own first. Pairs that are frequent enough that at most FREQUENT are as frequent are broadcast, the others meet documents in a join.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import held, materialize, release, temporary
from .packing import _RARE, Encoder

#: Pairs that are broadcast at most; words of a worker's cache, which then starts anew, the longest it keeps, and how many are learned at once; pairs that a task gathers before it sends them.
FREQUENT, CACHE_ENTRIES, LONGEST, LEARN, GATHER = 1 << 18, 150_000, 64, 1 << 13, 1 << 20
#: U+2581, which stands for a space in pieces.
_SPACE = "▁"
#: White space whose neighbours depend on each other in either tokenizer.
_TIED = re.compile(r"\s |^ | $| \s")


class IntervalIndex:
    """Intervals that follow each other without gaps, given by their ends; the first begins at 0."""

    def __init__(self, ends: np.ndarray) -> None:
        self.ends = np.asarray(ends, np.int64)
        self.begins = np.append(0, self.ends)[:-1]

    def overlapping(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each [begin, end) the first interval that overlaps it, and the one after the last, by bisection."""
        return np.searchsorted(self.ends, begin, "right"), np.searchsorted(self.begins, end, "left")


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the ends of two lists of tokens over the same bytes: the group of each token of A, of each of B, and for each of A the place of the one of B that ends with it, or -1."""
    a, index = np.asarray(a, np.int64), IntervalIndex(b)
    low, high = index.overlapping(np.append(0, a)[:-1], a)
    spans = np.zeros(len(index.ends) + 1, np.int64)  # tokens of A that begin or end to span the gap after each token of B
    np.add.at(spans, low, 1)
    np.add.at(spans, high - 1, -1)
    parted = np.cumsum(spans)[: len(index.ends)] == 0
    group_b = np.append(0, np.cumsum(parted))[: len(index.ends)]
    ends = index.ends[high - 1] == a if len(a) else np.zeros(0, bool)
    return group_b[low], group_b, np.where(ends, high - 1, -1)


class BytePieces(Encoder):
    """Ids of a byte-level file, for which strings of special tokens are plain text, and the bytes of each."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.parts = None
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.bytes_of = {i: bytes(map(shown.__getitem__, t)) if all(c in shown for c in t) else t.encode() for t, i in self.library.get_vocab().items()}

    def pieces(self, text: str) -> list[int]:
        return np.frombuffer(self.ids(text), np.uint32).tolist()


class SpacePieces:
    """Ids of a sentencepiece model, and the bytes of each."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = {i: bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)}
        self.by_word = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in names)

    def pieces(self, text: str) -> list[int]:
        return self.library.encode(text)


Aligned = tuple[bytes, bytes, int, int]  # the groups as text, the pairs as numbers (a << 32 | b), tokens of A << 32 | tokens of B, groups


class _Names:
    """What is written for each id, with what follows it."""

    def __init__(self, bytes_of: dict[int, bytes], more: str, last: str) -> None:
        top = max(bytes_of) + 1
        self.bytes_of = [bytes_of.get(i, b"") for i in range(top)]
        self.lengths = np.array(list(map(len, self.bytes_of)), np.int64)
        self.more, self.last = (np.array([f"{i}{mark}" for i in range(top)], object) for mark in (more, last))


class Aligner(dict):
    """What words of texts give, learned as they come, many at once."""

    def __init__(self, a: str, b: str) -> None:
        super().__init__()
        self.a, self.b = BytePieces(a), SpacePieces(b)
        self.names_a, self.names_b = _Names(self.a.bytes_of, ",", "|"), _Names(self.b.bytes_of, ",", ";")

    def aligned(self, texts: list[str], encode: Callable[[str], list[int]]) -> list[Aligned | None]:
        """Each text by itself; encode gives the tokens of A for a space and a text. None where the bytes of either side's tokens aren't those of a space and the text."""
        if not texts:
            return []
        spaced = [" " + t for t in texts]
        raw = [t.encode() for t in spaced]
        each = [list(map(encode, spaced)), self.b.library.encode(texts, num_threads=1)]
        counts = [np.array(list(map(len, e)), np.int64) for e in each]
        flat = [np.fromiter(itertools.chain.from_iterable(e), np.int64, int(n.sum())) for e, n in zip(each, counts, strict=True)]
        upto = np.cumsum(list(map(len, raw)))
        ends = []
        for names, ids, n in zip((self.names_a, self.names_b), flat, counts, strict=True):
            end = np.cumsum(names.lengths[ids])
            last = np.cumsum(n)
            fits = (n > 0).all() and len(end) and (end[last - 1] == upto).all() and b"".join(map(names.bytes_of.__getitem__, ids.tolist())) == b"".join(raw)
            if not fits:  # halves, down to the ones that don't
                half = len(texts) // 2
                return self.aligned(texts[:half], encode) + self.aligned(texts[half:], encode) if half else [None]
            ends.append(end)
        group_a, group_b, met = align(*ends)
        (ids_a, ids_b), (last_a, last_b) = flat, (np.cumsum(n) for n in counts)
        begin_b, end_a = np.searchsorted(group_b, np.arange(group_b[-1] + 1)), np.searchsorted(group_a, np.arange(group_b[-1] + 1), "right")
        shown = np.empty(len(ids_a) + len(ids_b), object)  # tokens of A of a group, then those of B
        closes_a, closes_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        at_a, at_b = np.arange(len(ids_a)) + begin_b[group_a], np.arange(len(ids_b)) + end_a[group_b]
        for at, ids, closes, names in ((at_a, ids_a, closes_a, self.names_a), (at_b, ids_b, closes_b, self.names_b)):
            shown[at[~closes]], shown[at[closes]] = names.more[ids[~closes]], names.last[ids[closes]]
        linked = np.flatnonzero(met >= 0)
        pairs = ids_a[linked] << 32 | ids_b[met[linked]]
        cut = np.append(0, last_a + last_b).tolist()
        cut_pairs = np.append(0, np.searchsorted(linked, last_a)).tolist()
        groups = np.diff(np.append(0, group_a[last_a - 1] + 1)).tolist()
        shown, both = shown.tolist(), (counts[0] << 32 | counts[1]).tolist()
        return [("".join(shown[cut[k] : cut[k + 1]])[:-1].encode(), pairs[cut_pairs[k] : cut_pairs[k + 1]].tobytes(), both[k], groups[k]) for k in range(len(texts))]

    def whole(self, text: str) -> Aligned | None:
        return self.aligned([text], self.a.pieces)[0]

    def learn(self, words: list[str]) -> dict[str, Aligned | None]:
        """The words that aren't known, LEARN at once; what is short enough is kept."""
        found: dict[str, Aligned | None] = {}
        for k in range(0, len(words), LEARN):
            part = words[k : k + LEARN]
            found.update(zip(part, self.aligned(part, self.a.fast), strict=True))
        if len(self) + len(found) > CACHE_ENTRIES:
            self.clear()
        self.update((w, f) for w, f in itertools.islice(found.items(), CACHE_ENTRIES) if len(w) <= LONGEST)
        return found

    def texts(self, texts: list[str | None]) -> list[Aligned | None]:
        apart = [t.split(" ") if t and self.a.fast and self.b.by_word and not _TIED.search(t) and not _RARE.search(t) else None for t in texts]
        wanted = dict.fromkeys(itertools.chain.from_iterable(filter(None, apart)))
        known = {w: f for w in wanted if (f := self.get(w))}
        known |= self.learn([w for w in wanted if w not in known])
        out: list[Aligned | None] = []
        for text, words in zip(texts, apart, strict=True):
            if not words:
                out.append(self.whole(text) if text else None)
                continue
            found = [known[w] for w in words]
            if None in found:
                out.append(self.whole(text))
            else:
                out.append((b";".join([f[0] for f in found]), b"".join([f[1] for f in found]), sum([f[2] for f in found]), sum([f[3] for f in found])))
        return out


_PAIRED = "key {}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def aligned_documents(docs: DataFrame, a: str, b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (a number), n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs of tokens that end together: arrays a, b and times."""
    kind = docs.schema[key].dataType.simpleString()

    def lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held("aligner", f"{a}\n{b}", lambda: Aligner(a, b))
        for batch in batches:
            found = aligner.texts(batch.column("text").to_pylist())
            pairs = [np.unique(np.frombuffer(f[1], np.int64), return_counts=True) if f else (np.empty(0, np.int64), np.empty(0, np.int64)) for f in found]
            at = np.concatenate([[0], np.cumsum([len(p) for p, _ in pairs])])
            flat, times = np.concatenate([p for p, _ in pairs]), np.concatenate([n for _, n in pairs])
            n = [(f[2] >> 32, f[2] & 0xFFFFFFFF, f[3], len(f[1]) // 8, hashlib.sha256(f[0]).hexdigest()) if f else (0, 0, 0, 0, "") for f in found]
            counts = [pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*n, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), *counts, lists(at, flat >> 32), lists(at, flat & 0xFFFFFFFF), lists(at, times)], names)

    names = [c.strip().partition(" ")[0] for c in _PAIRED.split(",")]
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _PAIRED.format(kind))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a batch's rows as numbers, their times, and the row of each."""
    of_a, of_b, times = (batch.column(c) for c in ("a", "b", "times"))
    n = of_a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return of_a.flatten().to_numpy().astype(np.int64) << 32 | of_b.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n (links of the corpus that hold it) and best (no pair with this token of B has more)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held_ = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, at, np.concatenate([t for _, t in parts]))
            return pairs, n

        for batch in batches:
            pairs, times, _ = _flat(batch)
            parts.append((pairs, times))
            held_ += len(pairs)
            if held_ > 2 * GATHER:
                parts = [merged()]
                held_ = len(parts[0][0])
                if held_ > GATHER:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, parts.pop())), ["pair", "n"])
                    held_ = 0
        if parts:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged())), ["pair", "n"])

    found = aligned.select("a", "b", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(W.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))  # rows of a token of B: the vocabulary of A at most
    return found.withColumn("best", F.col("n") == most)


def _least_count(counts: DataFrame, most: int) -> int:
    """A power of two that at most so many pairs reach in count."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("pairs")).orderBy(F.desc("bits")).collect()  # 64 rows at most
    least, pairs = (1 << 63) - 1, 0
    for bits, n in sizes:
        pairs += n
        if pairs > most:
            break
        least = 1 << (bits - 1)
    return least


def alignment_scores(docs: DataFrame, a: str, b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs, whole texts.

    a is the path of a byte-level file, which reads a space and the text; b that of a sentencepiece model, which adds the space itself.
    A null or empty text, and one that the tokens of either side don't give back byte by byte, has no tokens: zeros and an empty
    groups_sha256. Repeated rows stay and count each. Further columns are not read.
    """
    with temporary() as result:
        aligned = materialize(aligned_documents(docs, a, b, key=key, text=text))
        counts = materialize(pair_counts(aligned))
        least = _least_count(counts, FREQUENT)
        known = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
        tiers = docs.sparkSession.sparkContext.broadcast(tuple(np.ascontiguousarray(known.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("pair", "n", "best")))

        def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            """The pairs, their times and rows, which are among the known, and the place of these."""
            pairs, times, row = _flat(batch)
            at = np.searchsorted(tiers.value[0], pairs)
            at[at == len(tiers.value[0])] = 0
            hit = tiers.value[0][at] == pairs if len(tiers.value[0]) else np.zeros(len(pairs), bool)
            return pairs, times, row, hit, at

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, times, row, hit, at = looked_up(batch)
                of, at, times = row[hit], at[hit], times[hit]
                n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.add.at(n_best, of, times * tiers.value[2][at])
                np.add.at(total, of, times * tiers.value[1][at])
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(n_best), pa.array(total)], [*batch.schema.names[:7], "n_best", "count_sum"])

        def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs, times, row, hit, _ = looked_up(batch)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("row").to_numpy()[row[~hit]]), pa.array(pairs[~hit]), pa.array(times[~hit])], ["row", "pair", "times"])

        first = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema.fields[:7])
        scored = aligned.mapInArrow(score, f"{first}, n_best long, count_sum long")
        rare = counts.where(F.col("n") < least)
        if rare.limit(1).count():
            rest = aligned.select("row", "a", "b", "times").mapInArrow(missed, "row long, pair long, times long").join(rare, "pair")
            rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
            scored = scored.join(rest, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
        return result(scored.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
