"""The query stages, for all queries at once: centroid search, gather, prune, refine; and exact scoring without an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lateloom.functions import arrays
from lateloom.functions.arrays import matrix
from lateloom.functions.shared import materialize
from lateloom.functions.vectors import dot
from lateloom.params import DimMismatch, NoGraph, SearchParams

from . import blocks, encode, hnsw, pq, scoring

#: Words of queries that are broadcast at once, and documents whose words are multiplied with them at once.
WORD_BLOCK, WORD_DOCS = 1_000_000, 64


def greatest(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row, greatest first; of equal ones the first."""
    rows, n = s.shape
    if k < n:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        above = s > least
        tied = s == least
        tied &= np.cumsum(tied, 1) <= k - above.sum(1, keepdims=True)
        at = np.nonzero(above | tied)[1].reshape(rows, k)
    else:
        at = np.tile(np.arange(n), (rows, 1))
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), 1, kind="stable"), 1)


def check_dims(query_tokens: DataFrame, centroids: DataFrame, column: str = "unit") -> None:
    """Raises unless all query tokens have as many components as the centroids."""
    lo, hi = query_tokens.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    n, dim = blocks.size_of(centroids, column)
    if lo is not None and n and not lo == hi == dim:
        raise DimMismatch(f"queries have {lo} to {hi} components, the index has {dim}")


def rounded(scored: DataFrame, digits: int = 9) -> DataFrame:
    """Scores as they are ordered."""
    return scored.withColumn("score", F.round("score", digits))


def score_order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.col("doc_id")]


def _nearest(kappa_c: int, digits: int) -> blocks.Kernel:
    def best(ids: np.ndarray, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = arrays.rounded(x @ c.T, digits)
        order = greatest(s, min(kappa_c, len(ids)))  # ids ascend
        return ids[order], np.take_along_axis(s, order, 1)

    return best


def centroid_packs(query_tokens: DataFrame, centroids: DataFrame, kappa_c: int, digits: int = 9) -> DataFrame:
    """As centroid_topk, with a row for each query token: qid, qpos, centroid_ids and sims."""
    if blocks.n_blocks(centroids, "unit") > 1:
        return hit_packs(centroid_topk(query_tokens, centroids, kappa_c, digits))
    dealt = query_tokens.repartition(2 * query_tokens.sparkSession.sparkContext.defaultParallelism, "qid", "qpos")  # lists are much larger than vectors
    return blocks.packed(dealt, ["qid", "qpos"], centroids, "unit", _nearest(kappa_c, digits), "centroid_ids int, sims double")


def hit_packs(hits: DataFrame) -> DataFrame:
    """Rows of hits as lists."""
    own = hits.groupBy("qid", "qpos").agg(F.collect_list(F.struct("centroid_id", "sim")).alias("own"))  # a token's hits
    return own.select("qid", "qpos", F.transform("own", lambda h: h["centroid_id"]).alias("centroid_ids"), F.transform("own", lambda h: h["sim"]).alias("sims"))


def centroid_topk(query_tokens: DataFrame, centroids: DataFrame, kappa_c: int, digits: int = 9, block_bytes: int | None = None) -> DataFrame:
    """qid, qpos, centroid_id, sim and rank of the kappa_c nearest centroids of each query token; the least id of equally near ones first.

    Centroids of more than block_bytes are parted, and each part is searched in tasks of its own.
    """

    best = _nearest(kappa_c, digits)
    found = blocks.meet(query_tokens, ["qid", "qpos"], centroids, "unit", best, "centroid_id int, sim double", block_bytes)
    if blocks.n_blocks(centroids, "unit", block_bytes) == 1:
        return found
    rank = F.row_number().over(W.partitionBy("qid", "qpos").orderBy(F.desc("sim"), "centroid_id"))  # kappa_c rows of each block
    return found.withColumn("rank", rank).where(F.col("rank") <= kappa_c)


def gather(hits: DataFrame, postings: DataFrame, best: int | None = None, digits: int = 9, n_hits: int = 0) -> DataFrame:
    """qid, doc_id and score: for each token of a query the best centroid that a document has, added up; tokens that reach nothing add 0.

    hits are rows (centroid_topk) or lists (centroid_packs). best: scores are rounded to digits, and of each query at least the best are
    given that come first by score_order(), for prune(). n_hits: how many hits there may be, by which they are dealt into slices.
    """
    return scoring.gather(hits if "sims" in hits.columns else hit_packs(hits), postings, n_hits, best, digits)


def prune(candidates: DataFrame, kappa_d: int, alpha: float | None = None) -> DataFrame:
    """The kappa_d best of each query, and of these those with alpha times the best score at least, where that is positive. Adds rank."""
    w = W.partitionBy("qid").orderBy(*score_order())
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kappa_d)
    if alpha is None:
        return ranked
    top = F.max("score").over(W.partitionBy("qid"))
    return ranked.withColumn("top", top).where((F.col("top") <= 0) | (F.col("score") >= alpha * F.col("top"))).drop("top")


def refine(survivors: DataFrame, query_tokens: DataFrame, doc_packs: DataFrame, centroids: DataFrame, codebook: DataFrame, best: int | None = None, digits: int = 9) -> DataFrame:
    """qid, doc_id and score: the sum over a query's tokens of the best of a document's tokens, each its centroid plus norm times decoded residual.

    Documents are rebuilt where they meet a slice of the queries, and multiplied with those that they are candidates for. Centroids are
    broadcast where they are one block, and travel with the documents' packs otherwise. best: scores are rounded to digits, and at least
    the best of each query are given, for top().
    """
    spark = survivors.sparkSession
    books = spark.sparkContext.broadcast(pq.book(codebook))
    if blocks.n_blocks(centroids, "unit") == 1:
        block = blocks.one_block(centroids, "unit")
        packs = doc_packs
    else:
        block = None
        one = doc_packs.select("doc_id", F.posexplode("centroid_ids").alias("at", "centroid_id")).join(centroids.select("centroid_id", "unit"), "centroid_id")
        vectors = one.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "unit"))), lambda s: s["unit"]).alias("units"))
        packs = doc_packs.join(vectors, "doc_id", "left")
    shared = spark.sparkContext.broadcast(block)

    def rebuild(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        words = books.value
        own = batch.column("centroid_ids")
        lengths = pc.list_value_length(own).to_numpy()
        if not lengths.sum():
            return np.zeros((0, words.shape[0] * words.shape[2])), lengths
        if shared.value is None:
            base = matrix(batch.column("units").flatten())
        else:
            ids, c = shared.value
            base = c[np.searchsorted(ids, own.flatten().to_numpy())]
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, words.shape[0])
        return base + batch.column("norms").flatten().to_numpy()[:, None] * pq.decode_rows(codes, words), lengths

    return scoring.score(packs, survivors.select("qid", "doc_id"), query_tokens, "centroid_ids", rebuild, best, digits)


def top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid").orderBy(*score_order()))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index, query_tokens: DataFrame, p: SearchParams, *, ef: int | None = None) -> DataFrame:  # noqa: ANN001
    """qid, rank, doc_id and score of the top_k documents of every query: gather, prune, refine. A query without tokens has no hits.

    Scores are rounded before they are ordered, in both places: equal sums stay equal in whatever order they were added, and the least id is first.
    Centroids are searched exactly or, with ef (the width of the search), by the index's graph.
    """
    p.check()
    check_dims(query_tokens, index.centroids)
    if ef is None:
        hits = centroid_packs(query_tokens, index.centroids, p.kappa_c)
    elif index.graph is None:
        raise NoGraph("the index has no graph")
    else:
        hits = hnsw.search(query_tokens, index.graph, p.kappa_c, ef=ef)
    survivors = prune(gather(hits, index.postings, p.kappa_d, n_hits=query_tokens.count() * p.kappa_c), p.kappa_d, p.alpha)
    scored = refine(survivors, query_tokens, index.doc_packs, index.centroids, index.codebook, p.top_k)
    return top(scored, p.top_k)


def summary(queries: DataFrame, query_tokens: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, n_tokens, n_hits and best (score) of each of queries (qid). One without tokens is skipped by a search: it has none of these."""
    tokens = query_tokens.groupBy("qid").agg(F.count("*").alias("n_tokens"))
    found = hits.groupBy("qid").agg(F.count("*").alias("n_hits"), F.max("score").alias("best"))
    zero = F.lit(0).cast("long")
    return queries.select("qid").distinct().join(tokens, "qid", "left").join(found, "qid", "left").select("qid", F.coalesce("n_tokens", zero).alias("n_tokens"), F.coalesce("n_hits", zero).alias("n_hits"), "best")


def brute_force(query_tokens: DataFrame, tokens: DataFrame, best: int | None = None, digits: int = 9) -> DataFrame:
    """qid, doc_id and score over whole vectors: each slice of the queries against all tokens, without an index. best: as refine() has it."""
    packs = tokens.groupBy("doc_id").agg(F.collect_list(F.col("vec").cast("array<double>")).alias("vecs"))

    def rebuild(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return matrix(batch.column("vecs").flatten()), pc.list_value_length(batch.column("vecs")).to_numpy()

    return scoring.score(packs, None, query_tokens, "vecs", rebuild, best, digits)


def word_search(docs: DataFrame, queries: DataFrame, k: int, *, text: str = "text") -> DataFrame:
    """qid, rank, doc_id and score, the number of distinct words that a document (doc_id) shares with a query (qid), of the k best documents.

    The queries' words are broadcast in blocks of WORD_BLOCK, and documents meet them where they are read: a product of a batch's
    documents by words with the block's words by queries, of which a task keeps the k best of each query. So a word that is in all
    documents is neither a hot key, nor makes rows.
    """
    spark = docs.sparkSession
    own = materialize(encode.token_ids(encode.words(queries, key="qid", text=text)).select("qid", "token_id").distinct())
    parts = max(1, -(-own.count() // WORD_BLOCK))
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_distinct(encode.word_list(F.col(text), False)).alias("words"))
    out = None
    for b in range(parts):
        t = own.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == b).toArrow()  # about WORD_BLOCK rows
        token, at = np.unique(t.column("token_id").to_numpy(), return_inverse=True)
        names, to = np.unique(t.column("qid").to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        shared = spark.sparkContext.broadcast((token, np.searchsorted(at[order], np.arange(len(token) + 1)), to[order], names))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            token, begin, to, names = shared.value
            known: dict[str, int] = {}
            best = [np.zeros(0, np.int64)] * 3  # query, document, score
            for batch in batches:
                words = batch.column(1).flatten().dictionary_encode()
                ids = np.array([encode.token_number(w, known) for w in words.dictionary.to_pylist()], np.int64)
                place = np.minimum(np.searchsorted(token, ids), max(len(token) - 1, 0))
                place = np.where(token[place] == ids, place, -1) if len(token) else np.full(len(ids), -1)
                doc = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
                word = place[words.indices.to_numpy()]
                doc, word = np.unique(np.stack([doc[word >= 0], word[word >= 0]]), axis=1)
                for a in range(0, len(batch), WORD_DOCS):
                    x, y = np.searchsorted(doc, (a, a + WORD_DOCS))
                    many = begin[word[x:y] + 1] - begin[word[x:y]]
                    entry = np.repeat(begin[word[x:y]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    counts = np.bincount(np.repeat(doc[x:y] - a, many) * len(names) + to[entry], minlength=0)
                    hit = np.flatnonzero(counts)
                    keys = batch.column(0).to_numpy()[a + hit // max(len(names), 1)]
                    best = [np.concatenate(c) for c in zip(best, (hit % max(len(names), 1), keys, counts[hit]), strict=True)]
                    order = np.lexsort((best[1], -best[2], best[0]))
                    best = [c[order] for c in best]
                    keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
                    best = [c[keep] for c in best]
            yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1]), pa.array(best[2].astype(np.float64))], ["qid", "doc_id", "score"])

        found = listed.mapInArrow(run, "qid long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, k)


def gather_sql(query_tokens: DataFrame, centroids: DataFrame, postings: DataFrame, kappa_c: int) -> DataFrame:
    """The same as centroid_topk and gather, in the JVM alone."""
    sims = query_tokens.join(centroids.select("centroid_id", "unit")).select("qid", "qpos", "centroid_id", F.round(dot(F.col("vec"), F.col("unit")), 9).alias("sim"))
    rank = F.row_number().over(W.partitionBy("qid", "qpos").orderBy(F.desc("sim"), "centroid_id"))
    return gather(sims.withColumn("rank", rank).where(F.col("rank") <= kappa_c), postings)


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid and the share of the k best of two rankings that both have."""
    both = a.where(F.col("rank") <= k).join(b.where(F.col("rank") <= k).select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("n"))
    return a.select("qid").distinct().join(both, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("overlap"))
