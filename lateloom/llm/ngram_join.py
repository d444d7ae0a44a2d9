"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by blocked products of the document by n-gram incidence.

1. Every text gives the set of its shingles' hashes. Texts with the same set are one class, a row of the incidence matrix.
2. Size-derived bounds: for a Jaccard similarity of t, a set of n shares at least ceil(t n) of its shingles, so it shares one of the
   first n - ceil(t n) + 1 in any order that is the same for all; and the other's size lies between t n and n / t. The order is
   rare shingles first, by counts over all documents in a table of fixed size, so that passages of many documents come last.
   Classes meet at a place: the first shingles that exactly the same classes share.
3. Rows are dealt into blocks, a class by the place where it meets most others; the block of a large place is split. A block is
   multiplied by its transpose, first over the first shingles alone: rows of which no pair can reach the bound by what it shares
   there go. What is left is multiplied over all columns (block_links): overlaps accumulate, pairs below the bound go, and what
   links gives components. Only a spanning forest leaves a product, never its pairs.
4. Where a place's classes are in one component, nothing is left to find. Elsewhere, pairs of blocks that meet there are
   multiplied in the same two steps, where only pairs in different components count.

So a link between components is never lost, only texts that may link are fetched, each once, and a group of thousands of near
copies costs a few dense products of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lists, materialize, mix, release, shingles, temporary, utf8, words
from .components import connected_components

#: Counters of shingles, and the least count in a task that makes one count as frequent.
COUNTERS, FREQUENT = 1 << 22, 16
#: Bits that tell which texts' whole sets are needed (8 MB; with more texts than bits, more texts are compared by tag than needed).
NEED_BITS = 1 << 26
#: Classes of a block, about, and their shingles, about; a longer text is alone in its block.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Columns of a product that are dense at once, and pairs of entries from which a product of first shingles is dense.
COLUMNS, DENSE = 4096, 1 << 18

_CODEC = "zstd"


def _hashed(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, shingle hashes, and how many come before each text."""
    for i, j, data, off in utf8(column):
        h, at = words(data, off)
        yield i, j, *shingles(h, at, size)


def _sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending."""
    own = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return (np.concatenate(own) if own else h[:0]), np.cumsum([0, *map(len, own)])


def _signs(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, that don't depend on order."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(c)))]) for c in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93)]
    one, two = (s[at[1:]] - s[at[:-1]] for s in sums)
    return one.view(np.int64), two.view(np.int64)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """For each counter, the binary logarithm of how often its shingles occur, where that is often: over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, _, h, _ in _hashed(batch.column(0), size):
                np.add.at(seen, (h % np.uint64(COUNTERS)).astype(np.int64), 1)
        often = np.flatnonzero(seen >= FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array(often.astype(np.int32)), pa.array(seen[often].astype(np.int64))], ["counter", "n"])

    found = rows.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    level = np.zeros(COUNTERS, np.uint8)
    level[found.column("counter").to_numpy()] = np.ceil(np.log2(found.column("n").to_numpy().astype(float))).astype(np.uint8)
    return level


def first_shingles(h: np.ndarray, percent: int, level: np.ndarray) -> np.ndarray:
    """Of a set (ascending), those of which a set that links shares one: rare ones first, and then by hash."""
    n = len(h)
    own = level[(h % np.uint64(COUNTERS)).astype(np.int64)]
    return h[np.argsort(own, kind="stable")[: n - -(-percent * n // 100) + 1]]


def jaccard_components(docs: DataFrame, *, size: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links reach) for every row of docs.

    Two documents link when 100 * common >= percent * united distinct shingles of size words, A-Z in lower case, parted by ASCII
    white space; one with fewer words is one shingle of all of them. Null and empty texts, and those without words, have no
    shingles and are alone: their component is their own key. Rows with a null key take part but name no component; one with
    none but such rows has a null name. Repeated rows stay. Keys are integers. Further columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.select("key", "text", F.xxhash64("key", "text").alias("tag"), F.xxhash64("text", "key").alias("tag2"))
    levels = spark.sparkContext.broadcast(frequencies(rows, size))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        level = levels.value
        for batch in batches:
            for i, j, h, at in _hashed(batch.column(1), size):
                h, at = _sets(h, at)
                chosen = [first_shingles(h[a:b], percent, level) if b > a else h[:0] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                flat = np.concatenate(chosen) if chosen else h[:0]
                columns = [pa.array(x, pa.int64()) for x in (np.diff(at), *_signs(h, at))]
                own = [batch.column(c).slice(i, j - i) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, *columns, lists(flat.view(np.int64), np.cumsum([0, *map(len, chosen)]), pa.int64())], ["key", "tag", "tag2", "n", "one", "two", "first"])

    with temporary() as result:
        described = result(rows.mapInArrow(describe, "key long, tag long, tag2 long, n long, one long, two long, first array<long>"))
        grouped = described.where("n > 0").groupBy("one", "two", "n").agg(F.min("key").alias("key"), F.min(F.struct("tag", "tag2", "first")).alias("own"))
        classes = materialize(grouped.select("one", "two", "n", "key", "own.*", F.monotonically_increasing_id().alias("id")))
        found = connected_components(_links(rows, classes, size, percent))
        linked = classes.select("one", "two", "n", "key", "id").join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
        names = linked.groupBy("component").agg(F.min("key").alias("component_id"))
        named = result(linked.join(names, "component").select("one", "two", "n", "component_id"))
    out = described.select("key", "n", "one", "two").join(named, ["one", "two", "n"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def _parts(many: Column, shingles_: Column) -> Column:
    """How many blocks so many classes make."""
    return F.ceil(F.greatest(many / BLOCK, shingles_ / BLOCK_SHINGLES)).cast("long")


def _links(rows: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """a and b: a forest over the classes' ids that spans all their links."""
    places = meeting_places(classes)
    sizes = places.groupBy("place").agg(F.count("*").alias("many"), F.sum("n").alias("all"), F.min("id").alias("hub"))
    largest = places.join(sizes, "place").groupBy("id", "n").agg(F.max(F.struct("many", "place", "all", "hub")).alias("home")).select("id", "n", "home.*")
    homes = materialize(largest.select("id", "n", F.col("place").alias("home"), _parts(F.col("many"), F.col("all")).alias("split"), "hub"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("split")))

    inside = places.join(homes.select("id", block.alias("block")), "id").select(F.col("block").alias("i"), F.col("block").alias("j"), "block", "place", "id", "n", F.col("id").alias("component"), "shared")
    own = _reachable(inside, percent)
    hubs = homes.where("split > 1").select(block.alias("i"), F.col("hub").alias("id")).distinct()  # holds a large place's blocks together
    own = materialize(own.unionByName(hubs.withColumn("j", F.col("i"))).distinct())
    read = own.select("id").distinct()
    texts = _texts(rows, read.join(classes.select("id", "tag", "tag2"), "id"))
    links = block_links(texts, own, size, percent)

    across = _still_needed(places, homes, connected_components(links), percent)
    more = across.select("id").distinct().join(read, "id", "left_anti").join(classes.select("id", "tag", "tag2"), "id")
    return links.union(block_links(texts.union(_texts(rows, more)), across, size, percent))


def meeting_places(classes: DataFrame) -> DataFrame:
    """place, id, n and shared (so many first shingles) where at least two classes meet. Shingles that the same classes share are one place."""
    entries = classes.select("id", F.col("n").cast("int").alias("n"), F.explode("first").alias("h"))
    met = entries.groupBy("h").agg(F.bit_xor(F.xxhash64("id")).alias("place"), F.count("*").alias("many")).where("many > 1").select("h", "place")
    return materialize(entries.join(met, "h").groupBy("place", "id", "n").agg(F.count("*").cast("int").alias("shared")))


def _still_needed(places: DataFrame, homes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """i, j (blocks) and id: rows that must be multiplied over all columns, as they may link different components."""
    at_place = places.join(found, places["id"] == found["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    is_open = at_place.groupBy("place").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("place")
    still = materialize(at_place.join(is_open, "place", "left_semi"))
    # blocks follow components now: a large component has blocks of its own, which need not meet each other
    sizes = found.join(homes, found["node"] == homes["id"]).groupBy("component").agg(_parts(F.count("*"), F.sum("n")).alias("parts")).where("parts > 1")
    where = still.select("id", "component").distinct().join(homes.select("id", "home", "split"), "id").join(sizes, "component", "left")
    alone = F.col("parts").isNotNull()
    block = F.when(alone, F.xxhash64("component", F.pmod(F.xxhash64("id"), F.col("parts")))).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("component"), F.col("split"))))
    dealt = materialize(still.join(where.select("id", block.alias("block")), "id"))
    there = dealt.groupBy("place", F.col("block").alias("other")).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least"), F.max("n").alias("most"))
    # rows that find another component of like size there
    useful = ((F.col("x") != F.col("y")) | (F.col("x") != F.col("component"))) & (F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent)
    met = dealt.join(there, "place").where(useful)
    return _reachable(met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "place", "id", "n", "component", "shared"), percent)


def _reachable(met: DataFrame, percent: int) -> DataFrame:
    """i, j and id, of rows (i, j, block: i or j, place, id, n, component, shared): those that may link across components, by what they share of their first shingles.

    Beyond the first shingles, the set whose last one of them comes earlier shares at most what it has left.
    """
    dealt = met.repartition("i", "j").sortWithinPartitions("i", "j", "place", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in _whole_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reachable(rows, percent)], ["i", "j", "id"])

    return materialize(dealt.mapInArrow(run, "i long, j long, id long"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of integers, sorted by the first two, in runs that end where these change."""
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if not batch.num_rows:
            continue
        last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut == 0 and rest and (rest[-1][0][-1] != columns[0][0] or rest[-1][1][-1] != columns[1][0]):
            yield [np.concatenate(c) for c in zip(*rest, strict=True)]
            rest = []
        if cut:
            yield [np.concatenate(c) for c in zip(*rest, [c[:cut] for c in columns], strict=True)]
            rest = []
        rest.append([c[cut:] for c in columns])
    if rest:
        yield [np.concatenate(c) for c in zip(*rest, strict=True)]


def _limits(n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes n and m can link, and of how many first shingles they need to share, then."""
    need = -(-percent * (n + m) // (100 + percent))
    beyond = np.maximum(-(-percent * n // 100), -(-percent * m // 100)) - 1
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m), np.maximum(need - beyond, 1)


def reachable(rows: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and id of whole groups that may link. Small groups' products are taken together, a large group's alone and dense."""
    i, j, block, place, ids, n, component, shared = rows
    new = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
    group = np.cumsum(new) - 1
    cell = np.append(True, new[1:] | (place[1:] != place[:-1]))
    begin = np.flatnonzero(cell)
    end = np.append(begin[1:], len(i))
    first = np.add.reduceat((block == i).astype(np.int64), begin)  # rows are sorted by block, and i is at most j
    diagonal = (i == j)[begin]
    split = np.where(diagonal, begin, begin + first)
    p, q = np.where(diagonal, end, split) - begin, end - split
    work = np.bincount(group[begin], p * q)
    large = work > DENSE
    out = [np.zeros(0, np.int64)]
    for g in np.flatnonzero(large).tolist():
        a, b = np.searchsorted(group, (g, g + 1))
        out.append(a + _dense_rows(*(c[a:b] for c in (i, block, place, ids, n, component, shared)), percent))
    small = np.flatnonzero(~large[group[begin]])
    at = 0
    while at < len(small):  # cells of whole groups, of DENSE pairs at most together
        total = np.cumsum((p * q)[small[at:]])
        to = at + max(1, int(np.searchsorted(total, DENSE, "right")))
        while to < len(small) and group[begin[small[to]]] == group[begin[small[to - 1]]]:
            to += 1
        own = small[at:to]
        out.append(_sparse_rows(group, begin[own], split[own], p[own], q[own], ids, n, component, shared, percent))
        at = to
    at = np.unique(np.concatenate(out))
    return i[at], j[at], ids[at]


def _sparse_rows(group, begin, split, p, q, ids, n, component, shared, percent) -> np.ndarray:  # noqa: ANN001, PLR0913
    """Rows (one for each id of a group) that may link, by the pairs of each cell: p rows from begin with q rows from split."""
    of = np.repeat(np.arange(len(p)), p * q)
    k = np.arange(len(of)) - np.repeat(np.cumsum(p * q) - p * q, p * q)
    x, y = begin[of] + k // q[of], split[of] + k % q[of]
    fits, least = _limits(n[x], n[y], percent)
    keep = fits & (component[x] != component[y])
    x, y, least = x[keep], y[keep], least[keep]
    if not len(x):
        return x
    order = np.lexsort((ids[y], ids[x], group[x]))
    x, y, least = x[order], y[order], least[order]
    begins = np.flatnonzero(np.append(True, (group[x][1:] != group[x][:-1]) | (ids[x][1:] != ids[x][:-1]) | (ids[y][1:] != ids[y][:-1])))
    enough = begins[np.add.reduceat(shared[x], begins) >= least[begins]]
    found = np.concatenate([x[enough], y[enough]])
    return found[np.unique(np.stack([group[found], ids[found]], 1), axis=0, return_index=True)[1]] if len(found) else found


def _dense_rows(i, block, place, ids, n, component, shared, percent) -> np.ndarray:  # noqa: ANN001, PLR0913
    """As _sparse_rows for one group, by a product of the incidence of ids and places, weighted by the shingles of a place."""
    own, first, row = np.unique(ids, return_index=True, return_inverse=True)
    at, column = np.unique(place, return_inverse=True)
    weight = np.zeros(len(at), np.float32)
    weight[column] = shared
    left = block[first] == i[0]
    a = np.flatnonzero(left)
    b = np.flatnonzero(~left) if not left.all() else a
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float64)
    for c in range(0, len(at), COLUMNS):
        x, y = np.searchsorted(column, (c, c + COLUMNS))
        m = np.zeros((len(own), min(COLUMNS, len(at) - c)), np.float32)
        m[row[x:y], column[x:y] - c] = 1
        common += m[a] @ (m[b] * weight[c : c + COLUMNS]).T
    fits, least = _limits(n[first[a]][:, None], n[first[b]][None, :], percent)
    may = fits & (common >= least) & (component[first[a]][:, None] != component[first[b]][None, :])
    return np.concatenate([first[a[may.any(1)]], first[b[may.any(0)]]])


def _needed_bits(tags: DataFrame) -> np.ndarray:
    bit = F.pmod(F.col("tag"), F.lit(NEED_BITS))
    found = tags.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(tag, {NEED_BITS}) & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(NEED_BITS // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def _texts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """id, size and packed (the text, compressed) for asked (id, tag, tag2). Rows with the same key and text may give it more than once."""
    asked = materialize(asked)
    bits = rows.sparkSession.sparkContext.broadcast(_needed_bits(asked))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        need, given = bits.value, np.zeros(0, np.int64)
        for batch in batches:
            tag = batch.column(1).to_numpy()
            b = tag & (NEED_BITS - 1)
            take = np.flatnonzero(((need[b >> 6] >> (b & 63)) & 1).astype(bool) & ~np.isin(tag, given))
            take = take[np.unique(tag[take], return_index=True)[1]]  # of repeated rows one
            given = np.concatenate([given, tag[take]])
            raw = [t.as_buffer() for t in batch.column(0).take(pa.array(take)).fill_null("")]
            packed = [pa.compress(t, codec=_CODEC, asbytes=True) for t in raw]
            columns = [*(batch.column(c).take(pa.array(take)) for c in (1, 2)), pa.array([t.size for t in raw], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tag", "tag2", "size", "packed"])

    texts = rows.select("text", "tag", "tag2").mapInArrow(pack, "tag long, tag2 long, size long, packed binary")
    return materialize(texts.join(asked.hint("merge"), ["tag", "tag2"]).select("id", "size", "packed"))


def block_links(texts: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: a forest over the ids that spans the links inside each group (i, j) of blocks (i, j, id)."""
    met = texts.join(blocks.hint("merge"), "id").select("i", "j", "id", "size", "packed").repartition("i", "j").sortWithinPartitions("i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at, ids, sets = None, [], []
        a, b = [], []

        def multiply() -> None:
            for x, y in forest(product(sets, percent)):
                a.append(ids[x])
                b.append(ids[y])

        for batch in batches:
            i, j, own, sizes = (batch.column(c).to_numpy().tolist() for c in range(4))
            for x, y, k, n, packed in zip(i, j, own, sizes, batch.column(4), strict=True):
                if (x, y) != at:
                    multiply()
                    at, ids, sets = (x, y), [], []
                if not ids or ids[-1] != k:
                    raw = np.frombuffer(pa.decompress(packed.as_buffer(), n, codec=_CODEC), np.uint8)
                    ids.append(k)
                    sets.append(np.unique(shingles(*words(raw, np.array([0, n])), size)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
        multiply()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialize(met.mapInArrow(run, "a long, b long"))


def product(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets (hashes ascending) link, by the product of their incidence matrix with its transpose."""
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    if m < 2:
        return np.zeros((m, m), bool)
    if m == 2:
        both = np.concatenate(sets)
        both.sort()
        common = np.zeros((2, 2), np.int64)
        common[0, 1] = (both[1:] == both[:-1]).sum()
    else:
        common = _overlaps(np.concatenate(sets), np.repeat(np.arange(m), n), m)
    return np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1)


def _overlaps(h: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """Common hashes of each two of m rows: columns with one entry add nothing, the others are dense in turn."""
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.append(True, h[1:] != h[:-1])
    alone = new & np.append(new[1:], True)
    row, column = row[~alone], np.cumsum(new[~alone]) - 1
    columns = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((m, m), np.float64)
    for c in range(0, columns, COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        x = np.zeros((m, min(COLUMNS, columns - c)), np.float32)
        x[row[a:b], column[a:b] - c] = 1
        common += x @ x.T
    return common.astype(np.int64)


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each component of the upper triangular matrix, its first row with each other."""
    either = linked | linked.T
    left = either.any(1)
    while left.any():
        root = int(left.argmax())
        inside, edge = np.zeros(len(left), bool), np.zeros(len(left), bool)
        inside[root] = edge[root] = True
        while edge.any():
            edge = either[edge].any(0) & ~inside
            inside |= edge
        left &= ~inside
        inside[root] = False
        for x in np.flatnonzero(inside).tolist():
            yield root, x
