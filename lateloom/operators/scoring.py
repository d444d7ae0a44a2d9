"""The work of gathering and scoring, on packed rows: queries meet documents in tasks, each of which has a part of the documents and a slice of the queries.

Neither a query token's hits nor the documents that they reach become rows: a task reads its part's postings, or its slice's queries, and
then streams the rest past them. With best, a task gives the best documents of each query in its part, which hold the best of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateloom.functions.arrays import matrix, rounded
from lateloom.functions.sampling import content

#: Postings of a part, hits of a slice, and tokens of a slice's queries.
PART_POSTINGS, SLICE_HITS, SLICE_TOKENS = 1 << 22, 1 << 20, 1 << 14
#: Tokens of documents, numbers of a product, and best similarities that a task holds at once.
TOKENS, PRODUCT, HELD = 1 << 16, 1 << 22, 1 << 23

_OUT = "qid long, doc_id long, score double"
_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _rows(found: _Found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["qid", "doc_id", "score"])


def _best(found: _Found, k: int) -> _Found:
    """The k best documents of each query, of equal ones the least ids."""
    order = np.lexsort((found[1], -found[2], found[0]))
    query, doc, score = (c[order] for c in found)
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], doc[keep], score[keep]


def _met(first: DataFrame, then: DataFrame, tasks: int) -> DataFrame:
    """Rows of both, dealt by part and slice: those of first come first."""
    only = lambda df, other: [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name not in df.columns]
    one = first.select("*", *only(first, then), F.lit(0).alias("kind"))
    both = one.unionByName(then.select("*", *only(then, first), F.lit(1).alias("kind")))
    return both.repartition(tasks, "part", "slice").sortWithinPartitions("part", "slice", "kind")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """Part and slice, kind, and the rows of a batch that share them."""
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("part", "slice", "kind")], 1)
        cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            part, slice_, kind = key[a].tolist()
            yield (part, slice_), kind, batch.slice(a, b - a)


def gather(packs: DataFrame, postings: DataFrame, n_hits: int, best: int | None, digits: int) -> DataFrame:
    """qid, doc_id and score from each query token's hits, packed (qid, qpos, centroid_ids, sims): for each token the best centroid that a document has, added up in the tokens' order."""
    spark = packs.sparkSession
    parts = max(1, -(-postings.count() // PART_POSTINGS))
    slices = max(-(-n_hits // SLICE_HITS), -(-2 * spark.sparkContext.defaultParallelism // parts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    docs = postings.select(of("doc_id", parts).alias("part"), every(slices).alias("slice"), F.col("centroid_id").cast("int").alias("centroid_id"), F.col("doc_id").cast("long").alias("doc_id"))
    asked = packs.select(every(parts).alias("part"), of("qid", slices).alias("slice"), F.col("qid").cast("long").alias("qid"), F.col("qpos").cast("int").alias("qpos"), "centroid_ids", "sims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pairs, tokens, n = None, [], [], 0
        for key, kind, rows in _runs(batches):
            if key != at:
                yield from found(pairs, tokens)
                at, pairs, tokens = key, [], []
            if kind == 0:
                pairs.append((rows.column("centroid_id").to_numpy(), rows.column("doc_id").to_numpy()))
                continue
            for qid, qpos, ids, sims in zip(*(rows.column(c) for c in ("qid", "qpos", "centroid_ids", "sims")), strict=True):
                tokens.append((qid.as_py(), qpos.as_py(), ids.values.to_numpy(), sims.values.to_numpy()))
        yield from found(pairs, tokens)

    def found(pairs: list[tuple[np.ndarray, np.ndarray]], tokens: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not pairs or not tokens:
            return
        centroid, doc = (np.concatenate(c) for c in zip(*pairs, strict=True))
        order = np.argsort(centroid, kind="stable")
        ids, begin, many = np.unique(centroid[order], return_index=True, return_counts=True)
        docs, place = np.unique(doc, return_inverse=True)
        place = place[order]
        total, mark = np.zeros(len(docs)), np.zeros(len(docs), np.int64)
        tokens.sort(key=lambda t: t[:2])
        out: list[_Found] = []
        reached: list[np.ndarray] = []
        for i, (qid, _, own, sims) in enumerate(tokens):
            up = np.argsort(sims, kind="stable")  # the best centroid of a document is met last
            own, sims = own[up], sims[up]
            c = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            there = ids[c] == own
            c, sims = c[there], sims[there]
            n = many[c]
            entry = np.repeat(begin[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit, sim = place[entry], np.repeat(sims, n)
            mark[hit] = np.arange(len(hit))
            last = mark[hit] == np.arange(len(hit))
            hit = hit[last]
            total[hit] += sim[last]
            reached.append(hit)
            if i + 1 < len(tokens) and tokens[i + 1][0] == qid:
                continue
            hit = np.unique(np.concatenate(reached))
            score = total[hit]
            total[hit], reached = 0.0, []
            if best is not None:
                score = rounded(score, digits)
                if len(hit) > best:
                    least = -np.partition(-score, best - 1)[best - 1]
                    hit, score = hit[score >= least], score[score >= least]
                _, hit, score = _best((np.zeros(len(hit), np.int64), hit, score), best)  # places ascend as ids do
            out.append((np.full(len(hit), qid), docs[hit], score))
            if sum(len(o[0]) for o in out[-64:]) > TOKENS or len(out) >= 64:
                yield _rows(tuple(np.concatenate(c) for c in zip(*out, strict=True)))
                out = []
        if out:
            yield _rows(tuple(np.concatenate(c) for c in zip(*out, strict=True)))

    return _met(docs, asked, parts * slices).mapInArrow(run, _OUT)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The different rows and each row's place among them, or the rows as they are (None) where few are alike."""
    _, first, at = np.unique(content(x), return_index=True, return_inverse=True)
    return (x[first], at) if 4 * len(first) < 3 * len(x) and (x[first][at] == x).all() else (x, None)


class _Asked:
    """A slice's queries in order: ids, where each begins, vectors; and the different ones with the vectors' places."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        qid, qpos, x = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((qpos, qid))
        self.ids, self.begin = np.unique(qid[order], return_index=True)
        self.end = np.append(self.begin[1:], len(qid))
        self.x = x[order]
        self.own, self.at = _distinct(self.x)

    def all(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Scores of all queries (columns) for documents whose tokens x begin there; 0 for one without tokens."""
        own, at = _distinct(x)
        cuts = [slice(a, b) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        cuts = cuts if at is None else [np.unique(at[c]) for c in cuts]
        best = np.zeros((len(cuts), len(self.own)))
        step = max(1, PRODUCT // max(len(own), 1))
        for a in range(0, len(self.own), step):
            s = own @ self.own[a : a + step].T
            for d, c in enumerate(cuts):
                if begin[d + 1] > begin[d]:
                    s[c].max(0, out=best[d, a : a + step])
        return np.add.reduceat(best if self.at is None else best[:, self.at], self.begin, axis=1)

    def some(self, x: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Scores of some queries, by their places, for one document."""
        if not len(x):
            return np.zeros(len(queries))
        n = self.end[queries] - self.begin[queries]
        first = np.cumsum(n) - n
        rows = np.repeat(self.begin[queries] - first, n) + np.arange(n.sum())
        return np.add.reduceat((self.x[rows] @ x.T).max(1), first)


#: From a batch of documents: their tokens' vectors, one after the other, and how many each has.
Rebuild = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def score(docs: DataFrame, wanted: DataFrame | None, query_tokens: DataFrame, size: str, rebuild: Rebuild, best: int | None, digits: int) -> DataFrame:
    """qid, doc_id and score: the sum over a query's tokens of the greatest inner product with a token of a document, for the pairs of wanted (qid, doc_id), or all.

    docs have doc_id, the list size of their tokens, and what rebuild needs. Vectors that occur more than once among the queries or
    in a run of documents are multiplied once.
    """
    spark = docs.sparkSession
    slices = max(1, -(-query_tokens.count() // SLICE_TOKENS))
    parts = max(1, -(-3 * spark.sparkContext.defaultParallelism // slices))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = query_tokens.select(every(parts).alias("part"), of("qid", slices).alias("slice"), F.col("qid").cast("long").alias("qid"), F.col("qpos").cast("int").alias("qpos"), F.col("vec").cast("array<double>").alias("vec"))
    if wanted is None:
        own = docs.select("*", every(slices).alias("slice"), F.lit(None).cast("array<long>").alias("qids"))
    else:
        by = wanted.groupBy("doc_id", of("qid", slices).alias("slice")).agg(F.collect_list(F.col("qid").cast("long")).alias("qids"))  # a slice's queries at most
        own = docs.join(by, "doc_id")
    own = own.withColumns({"part": of("doc_id", parts), "doc_id": F.col("doc_id").cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, ask = None, [], None
        kept: list[_Found] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                yield _rows(_best(tuple(np.concatenate(c) for c in zip(*kept, strict=True)), best))
                kept.clear()

        for key, kind, met in _runs(batches):
            if key != at:
                yield from flush()
                at, rows, ask = key, [], None
            if kind == 0:
                rows.append((met.column("qid").to_numpy(), met.column("qpos").to_numpy(), matrix(met.column("vec"))))
                continue
            if rows:
                ask, rows = _Asked(rows), []
            if ask is None:
                continue
            lengths = pc.fill_null(pc.list_value_length(met.column(size)), 0).to_numpy()
            tokens, most = np.cumsum(lengths), max(1, HELD // len(ask.own))
            a = 0
            while a < len(met):
                b = max(a + 1, min(a + most, int(np.searchsorted(tokens, tokens[a] - lengths[a] + TOKENS, "right"))))
                found = _scores(ask, met.slice(a, b - a))
                a = b
                if best is None:
                    yield _rows(found)
                    continue
                kept.append(found)
                if sum(len(f[0]) for f in kept) > HELD // 4:
                    kept[:] = [_best(tuple(np.concatenate(c) for c in zip(*kept, strict=True)), best)]
        yield from flush()

    def _scores(ask: _Asked, met: pa.RecordBatch) -> _Found:
        x, lengths = rebuild(met)
        begin = np.append(0, np.cumsum(lengths))
        doc = met.column("doc_id").to_numpy()
        lists = met.column("qids")
        if lists.null_count:
            s = ask.all(x, begin)
            d, q = np.indices(s.shape).reshape(2, -1) if best is None else (None, None)
        else:
            ids = lists.flatten().to_numpy()
            q = np.minimum(np.searchsorted(ask.ids, ids), len(ask.ids) - 1)
            d = np.repeat(np.arange(len(met)), lists.value_lengths().to_numpy())
            d, q = d[ask.ids[q] == ids], q[ask.ids[q] == ids]  # not those without tokens
            if 4 * len(q) < len(met) * len(ask.ids):
                cut = np.searchsorted(d, np.arange(len(met) + 1))
                one = [ask.some(x[begin[i] : begin[i + 1]], q[cut[i] : cut[i + 1]]) for i in range(len(met)) if cut[i + 1] > cut[i]]
                value = np.concatenate(one) if one else np.zeros(0)
                return ask.ids[q], doc[d], value if best is None else rounded(value, digits)
            s = ask.all(x, begin)
            if best is not None:
                there = np.full(s.shape, -np.inf)
                there[d, q] = s[d, q]
                s = there
        if best is None:
            return ask.ids[q], doc[d], s[d, q]
        s = rounded(s, digits)
        least = -np.partition(-s, best - 1, axis=0)[best - 1] if len(s) > best else np.full(s.shape[1], -np.inf)
        d, q = np.nonzero((s >= least) & (s > -np.inf))
        return ask.ids[q], doc[d], s[d, q]

    return _met(asked, own, parts * slices).mapInArrow(run, _OUT)
