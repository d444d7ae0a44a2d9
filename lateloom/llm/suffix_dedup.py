"""Repeated long byte strings, found by suffix arrays of shards.

A byte goes where a string of `length` bytes covers it that also starts elsewhere, in any document. To compare only what can be
equal, every such string (a window) is assigned to the least hash of the k-grams inside it, its anchor: equal windows have equal
anchors. Windows in a row with one anchor form a segment.

1. Each text's distinct segments (two hashes of 8 bytes each) meet by anchor. An anchor seen once has no repeats. A segment
   seen twice is repeated as a whole. What is left are segments that occur once, at an anchor where others occur: the borders of
   repeats.
2. Only those, and one copy of each other segment at their anchors, are fetched as text and dealt by anchor into shards; an anchor
   with very many different segments is dealt anew by the windows' place relative to it.
3. Each shard's strings are suffix-sorted by external induced sorting (induced_sort), and neighbours that share `length` bytes
   mark their windows as repeated.
4. The marks return to the texts that have any, which compute their segments once more and cut the covered bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import induced_sort
from ._shared import materialize, mix, powers, prefix_hash, release, temporary, utf8

#: Bits of the bitmap that tells which texts have any mark (8 MB).
ROW_BITS = 1 << 26
#: Different segments of an anchor that stay in one shard; of more, each is cut into slices by place, SLICES at most, which are dealt by what they have in common with others.
SPLIT, SLICES = 4096, 8
#: Bytes of texts whose segments are computed together: some 100 bytes of memory each.
RUN_BYTES = 1 << 18
#: Bytes of a text whose segments are computed at once; places in it need PLACE_BITS.
PIECE, PLACE_BITS = 1 << 23, 24
#: Strings of a shard that are sorted together hold so many bytes at most, unless one anchor has more.
SORT_BYTES = 1 << 20


def segments(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: each segment's text, first window, windows, anchor's place, anchor and own hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    p = prefix_hash(data)
    inverse = powers(n)[1]
    h = mix((p[gram:] - p[:-gram]) * inverse[: n - gram + 1])
    span = length - gram + 1  # k-grams of a window
    low = np.uint64((1 << PLACE_BITS) - 1)
    coded = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones is least
    blocks = -(-len(coded) // span)
    padded = np.full(blocks * span, np.uint64(2**64 - 1))
    padded[: len(coded)] = coded
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & low).astype(np.int64)
    valid = np.zeros(windows + 1, np.int32)
    long = np.flatnonzero(np.diff(off) >= length)
    np.add.at(valid, off[long], 1)
    np.add.at(valid, off[long + 1] - length + 1, -1)
    inside = np.cumsum(valid[:windows]) > 0
    first = inside.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    starts = np.zeros(windows + 1, bool)
    starts[off[long]] = True
    begin = np.flatnonzero(first | (starts[:windows] & inside))
    last = np.searchsorted(begin, begin, "right")
    ends = np.append(begin, windows)[last]
    text = np.searchsorted(off, begin, "right") - 1
    count = np.minimum(ends, off[text + 1] - length + 1) - begin
    at = place[begin]
    own = (p[begin + count - 1 + length] - p[begin]) * inverse[begin]
    own = mix(own ^ (count.astype(np.uint64) << np.uint64(32)) ^ (at - begin).astype(np.uint64)) ^ h[at]
    return text, begin, count, at, h[at].view(np.int64), own.view(np.int64)


def _pieces(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """segments(), for texts of any length: a text that is too long is taken in overlapping pieces."""
    if len(data) <= PIECE + length:
        return segments(data, off, length, gram)
    found = []  # it is alone
    for at in range(0, len(data) - length + 1, PIECE):
        piece = data[at : at + PIECE + length - 1]
        text, begin, count, place, anchor, own = segments(piece, np.array([0, len(piece)]), length, gram)
        found.append((text, begin + at, count, place + at, anchor, own))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _unpacked(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.decompress(t.as_buffer()) for t in texts], pa.large_binary())


def _hits(rows: DataFrame) -> np.ndarray:
    bit = F.pmod(F.xxhash64("row"), F.lit(ROW_BITS))
    found = rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(ROW_BITS // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def _has(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    b = hashed % ROW_BITS  # as pmod: the modulus is positive
    return ((bits[b >> 6] >> (b & 63)) & 1).astype(bool)


def repeated_windows(t: np.ndarray, length: int, memory: int | None = None) -> np.ndarray:
    """Whether the window that starts at each place of t (symbols of induced_sort) starts elsewhere too."""
    order, shared = induced_sort.suffix_array(t, length, memory)
    same = shared >= length
    out = np.zeros(len(t), bool)
    out[order[same]] = True
    out[order[:-1][same[1:]]] = True
    return out


def _sort_shard(group: list[tuple], length: int, memory: int | None) -> Iterator[tuple[int, int, int, bytes]]:
    """row, own, first window of the slice, and a bit for each of its windows, of the segments to be marked."""
    size = sum(len(g[5]) + 1 for g in group) + 1
    t = np.full(size, induced_sort.END, np.int16)
    at, begins = 0, []
    for g in group:
        begins.append(at)
        t[at : at + len(g[5])] = np.frombuffer(g[5], np.uint8)
        t[at : at + len(g[5])] += induced_sort.BYTES
        at += len(g[5]) + 1
    t[-1] = induced_sort.LAST
    again = repeated_windows(t, length, memory)
    for (_, row, own, mark, skip, raw), b in zip(group, begins, strict=True):
        if mark:
            found = again[b : b + len(raw) - length + 1]
            if found.any():
                yield row, own, skip, np.packbits(found).tobytes()


def repeats(rows: DataFrame, *, length: int = 200, gram: int = 40, memory: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For rows (row: a number of its own, text): marks (row, own, skip, bits) of segments with repeated windows, and the texts (row, packed: compressed) that may have any."""
    spark = rows.sparkSession

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, off in utf8(batch.column(1), RUN_BYTES):
                text, _, _, _, anchor, own = _pieces(data, off, length, gram)
                if not len(text):
                    continue
                order = np.lexsort((own, text))
                text, anchor, own = text[order], anchor[order], own[order]
                new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (own[1:] != own[:-1])))
                many = np.minimum(np.diff(np.append(new, len(text))), 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[new], own[new], ids[i + text[new]], many.astype(np.int32))], ["anchor", "own", "row", "many"])

    met = rows.mapInArrow(meet, "anchor long, own long, row long, many int").repartition("anchor")
    by_own, by_anchor = W.partitionBy("anchor", "own"), W.partitionBy("anchor")
    met = met.withColumns({"total": F.sum("many").over(by_own), "one": F.min("row").over(by_own)})
    met = met.withColumns({"all": F.sum("many").over(by_anchor), "least": F.min("total").over(by_anchor), "kinds": F.sum(F.when(F.col("row") == F.col("one"), 1).otherwise(0)).over(by_anchor)})
    met = met.where("all > 1").select(
        "anchor", "own", "row", (F.col("total") == 1).alias("single"), ((F.col("least") == 1) & (F.col("row") == F.col("one"))).alias("fetch"), F.least(F.ceil(F.col("kinds") / SPLIT), F.lit(SLICES)).cast("int").alias("split")
    )
    met = materialize(met)
    bits = spark.sparkContext.broadcast(_hits(met))

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["row", "text"]).filter(pa.array(_has(bits.value, batch.column(1).to_numpy())))
            packed = [zlib.compress(t.as_buffer(), 1) for t in own.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(packed, pa.binary())], ["row", "packed"])

    texts = materialize(rows.select("row", F.xxhash64("row").alias("hashed"), "text").mapInArrow(hit, "row long, packed binary"))
    asked = met.where("fetch").groupBy("row").agg(F.collect_list(F.struct("own", "single", "split")).alias("asked"))  # of one text

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows_, asked_ = batch.column(0).to_pylist(), batch.column(2)
            for i, j, data, off in utf8(_unpacked(batch.column(1)), RUN_BYTES):
                text, begin, count, place, anchor, own = _pieces(data, off, length, gram)
                bounds = np.searchsorted(text, np.arange(j - i + 1))
                out: list[list] = [[] for _ in range(8)]
                for k in range(i, j):
                    a, b = bounds[k - i], bounds[k - i + 1]
                    where = {int(o): a + x for x, o in reversed(list(enumerate(own[a:b].tolist())))}
                    for q in asked_[k].as_py():
                        s = where[q["own"]]
                        first, n, shift = int(begin[s]), int(count[s]), int(place[s] - begin[s])
                        step = -(-(length - gram + 1) // q["split"])  # windows of a slice, by their place before the anchor
                        x = 0
                        while x < n:
                            part = (shift - x) // step
                            y = n if q["split"] == 1 else min(n, max(shift - part * step + 1, x + 1))
                            raw = data[first + x : first + y - 1 + length].tobytes()
                            # the bytes that all windows at these places have: equal windows are dealt alike, however many share the anchor
                            latest, earliest = int(place[s]) - part * step, int(place[s]) - min(part * step + step - 1, length - gram)
                            core = 0 if q["split"] == 1 else zlib.crc32(data[latest : earliest + length].tobytes())
                            for c, v in zip(out, (int(anchor[s]), 0 if q["split"] == 1 else part, core, rows_[k], q["own"], q["single"], x, raw), strict=True):
                                c.append(v)
                            x = y
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["anchor", "part", "core", "row", "own", "single", "skip", "raw"])

    wanted = texts.join(asked.hint("merge"), "row").select("row", "packed", "asked")
    dealt = wanted.mapInArrow(fetch, "anchor long, part int, core long, row long, own long, single boolean, skip int, raw binary").repartition("anchor", "part", "core").sortWithinPartitions("anchor", "part", "core")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        group: list[tuple] = []
        size, at = 0, None

        def marks() -> pa.RecordBatch:
            found = list(_sort_shard(group, length, memory))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], ["row", "own", "skip", "bits"])

        for batch in batches:
            for anchor, part, core, row, own, single, skip, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORT_BYTES and (anchor, part, core) != at:
                    yield marks()
                    group, size = [], 0
                at = (anchor, part, core)
                group.append((at, row, own, single, skip, raw))
                size += len(raw)
        if group:
            yield marks()

    whole = met.where("not single").select("row", "own", F.lit(0).alias("skip"), F.lit(None).cast("binary").alias("bits"))
    return whole.unionByName(materialize(dealt.mapInArrow(sort, "row long, own long, skip int, bits binary"))), texts


def _spans(n: int, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that windows at starts cover."""
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + length, -1)
    inside = np.cumsum(cover) > 0
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    return change[::2], change[1::2]


def remove_repeats(docs: DataFrame, *, length: int = 200, gram: int = 40, memory: int | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "sha256") -> DataFrame:
    """The columns keep, n_bytes, n_removed, n_spans (runs removed) and kept_sha256 (hexadecimal) or, with out="text", kept_text, for every row of docs.

    kept_text drops a character of which a byte goes, so that it stays UTF-8; the counts are of bytes. Null texts are empty; a
    text under length bytes has no windows. Repeated rows are documents of their own, and so repeat each other. Other columns
    than keep are not read. memory: bytes of a sort's queues beyond which they go to the task's scratch file (induced_sort.MEMORY).
    """
    if gram >= length:
        raise ValueError("gram must be less than length")
    spark = docs.sparkSession
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    # stored, as the rows are read more than once and their numbers must not change
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *columns))
    kind = "kept_sha256" if out == "sha256" else "kept_text"

    def result(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
        removed = int((ends - begins).sum())
        parts = [raw[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(raw)], strict=True)]
        kept = b"".join(parts)
        if out == "sha256":
            return len(raw), removed, len(begins), hashlib.sha256(kept).hexdigest()
        return len(raw), removed, len(begins), b"".join(p.decode(errors="ignore").encode() for p in parts).decode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2)
            got: list[tuple] = []
            for i, j, data, off in utf8(_unpacked(batch.column(1)), RUN_BYTES):
                text_, begin, count, _, _, own = _pieces(data, off, length, gram)
                bounds = np.searchsorted(text_, np.arange(j - i + 1))
                for k in range(i, j):
                    raw = data[off[k - i] : off[k - i + 1]]
                    a, b = bounds[k - i], bounds[k - i + 1]
                    where: dict[int, list[int]] = {}
                    for x, o in enumerate(own[a:b].tolist()):
                        where.setdefault(o, []).append(a + x)
                    starts = [np.zeros(0, np.int64)]
                    for m in asked[k].as_py() or ():
                        for s in where[m["own"]]:
                            here = begin[s] - off[k - i]
                            if m["bits"] is None:
                                starts.append(np.arange(here, here + count[s]))
                            else:
                                starts.append(here + m["skip"] + np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8))))
                    got.append((ids[k], *result(raw.tobytes(), *_spans(len(raw), np.concatenate(starts), length))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in enumerate(kinds)], ["row", "n_bytes", "n_removed", "n_spans", kind])

    with temporary() as table:
        marks, texts = repeats(rows.select("row", "text"), length=length, gram=gram, memory=memory)
        marks = marks.groupBy("row").agg(F.collect_list(F.struct("own", "skip", "bits")).alias("marks"))  # of one text
        changed = texts.join(marks.hint("merge"), "row").select("row", "packed", "marks").mapInArrow(cut, f"row long, n_bytes long, n_removed long, n_spans long, {kind} string")
        changed = table(changed)
    bits = spark.sparkContext.broadcast(_hits(changed))
    names = [f"k{i}" for i in range(len(keep))]
    head = rows.select("row", F.xxhash64("row").alias("hashed"), *names, "text")
    fields = [f for f in head.schema if f.name not in ("hashed", "text")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        none = np.zeros(0, np.int64)
        for batch in batches:
            maybe = _has(bits.value, batch.column("hashed").to_numpy())
            got = [result(t.encode(), none, none) for t in batch.column("text").to_pylist()]
            values = [pa.array([g[c] for g in got], t) for c, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(maybe), *values], [*(f.name for f in fields), "maybe", "n_bytes", "n_removed", "n_spans", kind])

    both = head.mapInArrow(plain, f"{schema}, maybe boolean, n_bytes long, n_removed long, n_spans long, {kind} string")
    numbers = ["n_bytes", "n_removed", "n_spans", kind]
    back = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    still = both.where("not maybe").select(*back, *numbers)
    joined = both.where("maybe").select("row", *names, *(F.col(c).alias(f"old_{c}") for c in numbers)).join(changed.hint("merge"), "row", "left")
    return still.unionByName(joined.select(*back, *(F.coalesce(c, f"old_{c}").alias(c) for c in numbers)))
