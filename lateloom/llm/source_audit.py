"""How sources of one language diverge in the words they use: distances of all pairs of sources, and each source's most typical terms.

Terms are counted where texts are read; a task sends one row for each (language, source, term) that it has gathered. With V kept
terms in a language, a source's share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)) in whole numbers, and two shares
differ by f = floor((p - q)^2 / q).

Pairs are sparse. Where neither source has a term, f is the pair's baseline, so a pair's sum is V baselines, corrected by terms
that one of the two has (for these only the histogram of a source's counts matters) and once more by terms that both have,
which are multiplied out in blocks of sources, term by term, and summed where they arise.

Ranks come from radix selection: in each round a histogram over the next bits of the values of each group says which digit holds
its k-th value, and only rows with that digit count on. Ties of one value go on in the same way over the bytes of their terms.
A window sorts only what is left: k rows a group and the last digit's, FINISH at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import materialize, release, temporary, text_or_empty

SCALE = 1_000_000_000
#: Entries that a task gathers before it sends them; sources of a block; pairs that a kernel holds at once.
GATHER, BLOCK, PAIRS = 200_000, 512, 1 << 20
#: Bits of a digit of values, bytes of a digit of terms, and the rows of a group that may be sorted in the end.
BITS, CHUNK, FINISH = 16, 2, 4096

GROUP = ["lang", "source"]

#: A-Z lower-cased; what is neither a letter of ASCII nor beyond it parts terms.
_TERMS = bytes((i + 32 if 65 <= i <= 90 else i) if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return raw.translate(_TERMS).split()


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with it), and for each group one row whose term is null. Null lang, source and text are empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        held = 0

        def gathered() -> Iterator[pa.RecordBatch]:
            for group, (n, d) in seen.items():
                kinds = [pa.array([x] * (len(n) + 1), pa.string()) for x in group]
                found = pa.array([None, *n], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([*kinds, found, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches:
            for key_lang, key_source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = seen.setdefault((key_lang, key_source), (Counter(), Counter()))
                before = len(n)
                n.update(found := terms(raw))
                d.update(set(found))
                held += len(n) - before
                if held > GATHER:
                    yield from gathered()
                    held = 0
        yield from gathered()

    rows = docs.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), F.encode(text_or_empty(text), "utf-8").alias("raw"))
    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, size: str) -> Column:
    """p, exact: the product has up to 30 digits."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0)) div CAST({size} AS DECIMAL(19, 0))")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """The rows of terms that at least that many documents of the language have, with total (the language's occurrences) and head (1 in one row of each term)."""
    of = W.partitionBy("lang", "term")
    all_ = counts.where("term IS NOT NULL").withColumns({"total": F.sum("n").over(of), "in_docs": F.sum("docs").over(of), "head": F.when(F.min("source").over(of) == F.col("source"), 1).otherwise(0)})
    return all_.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "head")


def group_sizes(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """For each group: at (its place among the language's sources), v (kept terms of the language), size and lang_size (N + V), p0 (the share of a term that it hasn't). p0 is null where nothing is kept."""
    own = kept.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sum("head").alias("heads"))
    groups = counts.where("term IS NULL").select(*GROUP).join(own, GROUP, "left").na.fill(0, ["n", "heads"])
    of = W.partitionBy("lang")
    sized = groups.withColumns({"v": F.sum("heads").over(of), "all": F.sum("n").over(of), "at": F.row_number().over(of.orderBy("source")).cast("long") - 1})
    sized = sized.select(*GROUP, "at", "v", (F.col("n") + F.col("v")).alias("size"), (F.col("all") + F.col("v")).alias("lang_size"))
    return sized.withColumn("p0", F.when(F.col("v") > 0, F.expr(f"1 + {SCALE} div greatest(size, 1)")))


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that both sources have add to a pair, summed over a batch's terms."""

    def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = column.flatten()
        return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), *(flat.field(name).to_numpy() for name in ("at", "p", "p0"))

    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        code, names = lang.indices.to_numpy().astype(np.int64), lang.dictionary
        (left, at, p, p0), (right, at2, q, q0) = entries(batch.column("x")), entries(batch.column("y"))
        other = (batch.column("a").to_numpy() != batch.column("b").to_numpy())
        row = np.repeat(np.arange(len(left)), left)
        ends = np.cumsum(right)
        fan = right[row]  # partners of each entry at the left
        done = np.concatenate([[0], np.cumsum(fan)])
        i = 0
        while i < len(row):
            j = max(i + 1, int(np.searchsorted(done, done[i] + PAIRS, "right")) - 1)
            s = np.repeat(np.arange(i, j), fan[i:j])
            t = np.arange(done[j] - done[i]) - (done[i:j] - done[i] - (ends - right)[row[i:j]])[s - i]
            more = _gaps(p[s], q[t]) - _gaps(p[s], q0[t]) - _gaps(p0[s], q[t]) + _gaps(p0[s], q0[t])
            parts = [(code[row[s]], at[s], at2[t], more)]
            if (turned := other[row[s]]).any():
                s, t = s[turned], t[turned]
                back = _gaps(q[t], p[s]) - _gaps(q[t], p0[s]) - _gaps(q0[t], p[s]) + _gaps(q0[t], p0[s])
                parts.append((code[row[s]], at2[t], at[s], back))
            of, one, two, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((two, one, of))
            of, one, two, value = of[order], one[order], two[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(of) else np.empty(0, np.int64)
            sums = np.add.reduceat(value, new) if len(new) else value
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of[new])), pa.array(one[new]), pa.array(two[new]), pa.array(sums)], ["lang", "s", "t", "value"])
            i = j


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value: f summed over all kept terms."""
    mine = groups.where("v > 0").select("lang", "source", "at", "size", "p0")
    rows = kept.join(mine, GROUP).select("lang", "term", "at", "n", _share("n", "size").alias("p"), "p0")
    entry = F.struct("at", "p", "p0")
    blocks = rows.repartition("lang", "term").groupBy("lang", "term", F.expr(f"at div {BLOCK}").alias("block")).agg(F.collect_list(entry).alias("entries"))
    met = blocks.select("lang", "term", F.col("block").alias("a"), F.col("entries").alias("x")).join(blocks.select("lang", "term", F.col("block").alias("b"), F.col("entries").alias("y")), ["lang", "term"]).where("a <= b")
    both = met.select("lang", "a", "b", "x", "y").mapInArrow(_products, "lang string, s long, t long, value long")

    two = groups.select("lang", F.col("at").alias("t"), F.col("p0").alias("q0"), "v")
    pairs = groups.select("lang", F.col("at").alias("s"), "p0").join(two, "lang").where("s <> t")
    base = pairs.select("lang", "s", "t", F.coalesce(F.col("v") * _gap("p0", "q0"), F.lit(0)).alias("value"))

    levels = rows.groupBy("lang", "at", "p", "p0").agg(F.count("*").alias("m"))
    one = levels.withColumnRenamed("at", "s").join(two.drop("v"), "lang").where("s <> t")
    one = one.groupBy("lang", "s", "t").agg(F.sum(F.col("m") * (_gap("p", "q0") - _gap("p0", "q0"))).alias("there"), F.sum(F.col("m") * (_gap("q0", "p") - _gap("q0", "p0"))).alias("back"))
    one = one.selectExpr("lang", "stack(2, s, t, there, t, s, back) AS (s, t, value)")

    sums = base.union(one).union(both.where("s <> t")).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    names = groups.select("lang", F.col("at").alias("s"), "source")
    return sums.join(names, ["lang", "s"]).join(names.withColumnsRenamed({"s": "t", "source": "item"}), ["lang", "t"]).select(*GROUP, "item", "value")


def typical_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term of the source that it has more of than its language) and value."""
    rows = kept.where("n > 0").join(groups.select(*GROUP, "size", "lang_size"), GROUP).withColumns({"p": _share("n", "size"), "q": _share("total", "lang_size")})
    return rows.where("p > q").select(*GROUP, F.col("term").alias("item"), _gap("p", "q").alias("value"))


def _edges(digits: DataFrame, by: list[str], order: Column) -> DataFrame:
    """by, the digit that holds the need-th row of each group, what is needed of it, and how many have it. digits: by, need and digit; groups with no more rows than needed are left out."""
    counted = digits.groupBy(*by, "need", "digit").agg(F.count("*").alias("rows"))
    up_to = F.sum("rows").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = counted.withColumn("up_to", up_to).where("up_to >= need AND up_to - rows < need")
    return edge.select(*by, "digit", (F.col("need") - F.col("up_to") + F.col("rows")).alias("need"), "rows")


def radix_top(rows: DataFrame, by: list[str], k: int, finish: int = FINISH) -> DataFrame:
    """rows (by, item string, value long from 0) that are among the first k of their group, by falling value, then by the bytes of item, with rank. rows should be a stored table: it is read in each round.

    One row a group is kept between rounds: the values from lo to hi hold its k-th row, need says how many of these are among
    the first k, size how many there are.
    """
    low = (1 << 63) - 1
    edge = rows.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("lo"), F.lit(low).cast("long").alias("hi"), F.lit(k).cast("long").alias("need"), F.lit(low).cast("long").alias("size"))
    edge = materialize(edge)
    for shift in range(64 - BITS, -1, -BITS):
        if not edge.where((F.col("size") > finish) & (F.col("need") < F.col("size"))).limit(1).count():
            break
        open_ = edge.where((F.col("size") > finish) & (F.col("need") < F.col("size")))
        digits = rows.join(open_, by).where("value BETWEEN lo AND hi").select(*by, "need", F.shiftright("value", shift).alias("digit"))
        found = _edges(digits, by, F.desc("digit")).select(*by, F.shiftleft("digit", shift).alias("new_lo"), (F.shiftleft("digit", shift) + F.lit((1 << shift) - 1)).alias("new_hi"), F.col("need").alias("new_need"), F.col("rows").alias("new_size"))
        was_open = (F.col("size") > finish) & (F.col("need") < F.col("size"))
        fewer = was_open & F.col("new_lo").isNull()  # the group has no more rows than needed: all are taken
        edge = materialize(
            edge.join(found, by, "left").select(
                *by,
                F.when(fewer, F.lit(0)).otherwise(F.coalesce("new_lo", "lo")).alias("lo"),
                F.when(fewer, F.lit(-1)).otherwise(F.coalesce("new_hi", "hi")).alias("hi"),
                F.when(fewer, F.lit(0)).otherwise(F.coalesce("new_need", "need")).alias("need"),
                F.when(fewer, F.lit(0)).otherwise(F.coalesce("new_size", "size")).alias("size"),
            )
        )
    # Ties of one value, where they are many: the same by bytes. start: what the k-th row's item begins with.
    edge = edge.withColumn("start", F.lit(b""))
    while (open_ := edge.where((F.col("size") > finish) & (F.col("need") < F.col("size")))).limit(1).count():
        tied = rows.join(open_, by).where(F.col("value") == F.col("lo")).withColumn("raw", F.encode("item", "utf-8")).where("substring(raw, 1, octet_length(start)) = start")
        spans = tied.groupBy(*by).agg(F.min("raw").alias("a"), F.max("raw").alias("b"))
        same = F.expr("aggregate(sequence(1, greatest(1, least(octet_length(a), octet_length(b)))), 0, (n, i) -> IF(n = i - 1 AND i <= octet_length(a) AND substring(a, i, 1) = substring(b, i, 1), i, n))")
        spans = materialize(spans.withColumn("same", same).select(*by, F.expr("substring(a, 1, same)").alias("common")))
        digits = tied.join(spans, by).select(*by, "need", F.expr(f"substring(raw, 1, octet_length(common) + {CHUNK})").alias("digit"))
        found = _edges(digits, by, F.asc("digit")).withColumnsRenamed({"digit": "new_start", "need": "new_need", "rows": "new_size"})
        edge = materialize(edge.join(found, by, "left").select(*by, "lo", "hi", F.coalesce("new_need", "need").alias("need"), F.coalesce("new_size", "size").alias("size"), F.coalesce("new_start", "start").alias("start")))
    begins = F.expr("substring(encode(item, 'utf-8'), 1, octet_length(start))")
    left = rows.join(edge, by).where((F.col("value") > F.col("hi")) | (F.col("value") >= F.col("lo")) & ((F.col("lo") < F.col("hi")) | (begins <= F.col("start"))))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "item"))
    return left.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "item", "value", "rank")


def audit_sources(docs: DataFrame, *, least: int = 3, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank. Part pair: all other sources of the language by falling divergence. Part term: the top terms that the source has more of than its language.

    Null text, lang and source are read as empty; a group without terms has shares of nothing, and a language without kept terms
    has pairs of value 0. Repeated rows are documents of their own. An empty table gives no rows. Further columns are not read.
    """
    with temporary() as result:
        counts = materialize(term_counts(docs, text=text, lang=lang, source=source))
        kept = materialize(kept_terms(counts, least))
        groups = materialize(group_sizes(counts, kept))
        pairs = pair_divergences(kept, groups)
        rank = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
        ranked = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
        best = radix_top(materialize(typical_terms(kept, groups)), GROUP, top)
        return result(ranked.union(best.select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank")))
