"""The query catalogue: each query over the given tables, by the library's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateloom.functions import sampling
from lateloom.functions import vectors as V
from lateloom.functions.shared import materialize, shared_path
from lateloom.operators import blocks, budget, cluster, encode, evaluate, hnsw, index, parity, pq, retrieve, stats
from lateloom.params import ClusteringParams, SearchParams, ef_search
from lateloom.sources import qrels as qrels_source
from lateloom.sources import tables as T
from lateloom.sources import token_dump

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STRICT = ClusteringParams(kappa=10)
MIXED = {"mu": 46, "tau": 50, "epsilon": 2, "theta": 5}
ACTIVE = ClusteringParams(kappa=32, mu=4, tau=8, epsilon=1, theta=1)
SMALL = SearchParams(kappa_c=16, kappa_d=20, alpha=None, top_k=10)
DIGITS = 9


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def emb(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "embeddings")


def tok(spark: SparkSession, d: str) -> DataFrame:
    return T.tokens_from_embeddings(emb(spark, d))


def fine(spark: SparkSession, d: str) -> DataFrame:
    return T.tokens_from_embeddings(emb(spark, d), fine=125)


def qt(spark: SparkSession, d: str) -> DataFrame:
    return T.queries_from_embeddings(emb(spark, d))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    return T.qrels_from_embeddings(emb(spark, d))


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Statistics with the spread rounded, so that allocations don't hang on the last bit."""
    return stats.spread(tok(spark, d)).withColumn("s_j", F.round("s_j", DIGITS))


def fine_tokens(spark: SparkSession, d: str, centroids: DataFrame) -> DataFrame:
    return fine(spark, d).join(F.broadcast(centroids.select("token_id", "centroid_id")), "token_id")  # 125 rows


def fine_index(spark: SparkSession, d: str) -> index.Index:
    """A mean centroid for each of 125 token ids, and as codewords 256 residuals (a codebook's size), evenly from the whole table."""
    centroids = materialize(cluster.mean_centroids(fine(spark, d), DIGITS))
    own = fine_tokens(spark, d, centroids)
    n = own.count()
    even = index.residuals(own.where((F.col("doc_id") * 10 + F.col("pos")) * 256 % F.lit(n) < 256), centroids, DIGITS, "raw")
    book = materialize(pq.train(even))
    return index.assemble(own, centroids, book, digits=DIGITS, base="raw")


def stored_index(spark: SparkSession, d: str) -> index.Index:
    """fine_index, with all of its tables written."""
    i = fine_index(spark, d)
    return index.Index(i.centroids, materialize(i.postings), i.codebook, materialize(i.doc_packs))


def ranks(df: DataFrame) -> DataFrame:
    """Hits as in the SQL: their scores have nine digits, so halves of the sixth occur, and the SQL's engine rounds by the product."""
    return df.select("qid", F.col("rank").cast("int").alias("rank"), "doc_id", V.rounded_by_product(F.col("score")).alias("score"))


# vectors


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    return a.join(e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b")))


@query
def vec_dot(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a_id", "b_id", V.rounded(V.dot(F.col("a"), F.col("b"))).alias("dot"))


@query
def vec_l2sq(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a_id", "b_id", V.rounded(V.l2sq(F.col("a"), F.col("b"))).alias("l2sq"))


@query
def vec_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    return blocks.cosines(e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b")), a, 6)


@query
def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    scaled = emb(spark, d).select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("vec_id") % 5)).alias("v"))
    return scaled.select("vec_id", F.posexplode(V.normalize(F.col("v"))).alias("d", "x")).select("vec_id", "d", V.rounded(F.col("x")).alias("x"))


@query
def vec_argmin(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select("vec_id", V.argmin(F.col("embedding")).alias("place"))


@query
def vec_argmax(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select("vec_id", V.argmax(F.col("embedding")).alias("place"))


@query
def l2_batch_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For each vector the nearest of those whose id is divisible by 50, the least id of equally near ones."""
    points = emb(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").cast("int").alias("centroid_id"), F.col("embedding").cast("array<double>").alias("raw"))
    own = emb(spark, d).select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("pos"), F.col("vec_id").alias("token_id"), F.col("embedding").cast("array<double>").alias("vec"))
    near = cluster.assign_nearest(own, points)
    return near.select(F.col("doc_id").alias("vec_id"), F.col("centroid_id").alias("nearest"), V.rounded(F.col("dist")).alias("dist"))


# statistics and budgets


@query
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return stats.frequency(fine(spark, d), dense=True)


@query
def token_spread(spark: SparkSession, d: str) -> DataFrame:
    return stats.spread(tok(spark, d)).select("token_id", "n_j", V.rounded(F.col("s_j")).alias("s_j"))


@query
def vocab_alias_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.alias_share(fine(spark, d))


@query
def token_tier(spark: SparkSession, d: str) -> DataFrame:
    return stats.frequency(tok(spark, d)).select("token_id", "n_j", stats.tier(F.col("n_j"), 46, 50).alias("tier"))


@query
def damped_weight(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("token_id", V.rounded(stats.damped_weight(F.col("n_j"), F.col("s_j"))).alias("w"))


@query
def ef_rule(spark: SparkSession, d: str) -> DataFrame:
    """The width of a graph search for as many results as each token id has rows."""
    return stats.frequency(fine(spark, d)).select("token_id", F.col("n_j").alias("k"), ef_search(F.col("n_j")).alias("ef"))


def _mixed_params(kappa: int) -> ClusteringParams:
    return ClusteringParams(kappa=kappa, **MIXED)


@query
def budget_tail(spark: SparkSession, d: str) -> DataFrame:
    return budget.tail(mixed(spark, d), _mixed_params(50)).select("token_id", "n_j", "tier", "k_tail", "left_over")


@query
def budget_damped(spark: SparkSession, d: str) -> DataFrame:
    return budget.damped(mixed(spark, d), _mixed_params(50)).select("token_id", F.col("k_damped").cast("long").alias("k_damped"), F.round(F.col("frac").cast("double"), 5).alias("frac"))


@query
def budget_zero_spread(spark: SparkSession, d: str) -> DataFrame:
    flat = mixed(spark, d).withColumn("s_j", F.lit(0.0))
    return budget.damped(flat, _mixed_params(50)).select("token_id", F.col("k_damped").cast("long").alias("k_damped"))


@query
def budget_bounded(spark: SparkSession, d: str) -> DataFrame:
    return budget.bounded(mixed(spark, d), _mixed_params(50)).select("token_id", F.col("k_bounded").cast("long").alias("k_bounded"))


def _reconciled(spark: SparkSession, d: str, kappa: int) -> DataFrame:
    return budget.reconcile(budget.bounded(mixed(spark, d), _mixed_params(kappa)), _mixed_params(kappa)).select("token_id", "tier", F.col("kappa_j").cast("long").alias("kappa_j"))


@query
def budget_surplus(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d, 60)


@query
def budget_deficit(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d, 17)


@query
def budget_all(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d, 40)


@query
def centroid_offsets(spark: SparkSession, d: str) -> DataFrame:
    return budget.allocate(mixed(spark, d), _mixed_params(40)).select("token_id", F.col("kappa_j").cast("long").alias("kappa_j"), F.col("centroid_lo").cast("long").alias("centroid_lo"))


# clustering


def _components(df: DataFrame, column: str) -> DataFrame:
    return df.select("centroid_id", "token_id", F.posexplode(column).alias("d", "x")).select("centroid_id", "token_id", "d", V.rounded(F.col("x")).alias("x"))


@query
def centroids_mean(spark: SparkSession, d: str) -> DataFrame:
    return _components(cluster.mean_centroids(fine(spark, d)), "raw")


@query
def centroids_unit(spark: SparkSession, d: str) -> DataFrame:
    return _components(cluster.mean_centroids(fine(spark, d)), "unit")


@query
def kmeans_degenerate(spark: SparkSession, d: str) -> DataFrame:
    return cluster.degenerate(fine(spark, d))


@query
def assign_nearest(spark: SparkSession, d: str) -> DataFrame:
    near = cluster.assign_nearest(fine(spark, d), cluster.mean_centroids(fine(spark, d)))
    return near.select("doc_id", "pos", "token_id", "centroid_id", V.rounded(F.col("dist")).alias("dist"))


def _own_distance(spark: SparkSession, d: str) -> DataFrame:
    joined = fine(spark, d).join(F.broadcast(cluster.mean_centroids(fine(spark, d))), "token_id")
    return joined.select("token_id", V.l2sq(F.col("vec"), F.col("raw")).alias("dist"))


@query
def wcss_by_token(spark: SparkSession, d: str) -> DataFrame:
    return _own_distance(spark, d).groupBy("token_id").agg(V.rounded(F.sum("dist")).alias("wcss"))


@query
def wcss_total(spark: SparkSession, d: str) -> DataFrame:
    near = cluster.assign_nearest(fine(spark, d), cluster.mean_centroids(fine(spark, d)))
    own = _own_distance(spark, d).agg(V.rounded(F.sum("dist"), 5).alias("own"))
    return own.join(near.agg(V.rounded(F.sum("dist"), 5).alias("global")))


@query
def lloyd_one_step(spark: SparkSession, d: str) -> DataFrame:
    """One round from the first eight vectors: each centroid's rows, and its new components."""
    t = tok(spark, d)
    start = t.where((F.col("doc_id") == 0) & (F.col("pos") < 8)).select(F.col("pos").alias("centroid_id"), F.transform("vec", lambda x: F.round(x, DIGITS)).alias("raw"))
    near = cluster.assign_nearest(t, start)
    joined = t.join(near.select("doc_id", "pos", "centroid_id"), ["doc_id", "pos"])
    means = joined.select("centroid_id", F.posexplode("vec").alias("d", "x")).groupBy("centroid_id", "d")
    return means.agg(F.count("*").alias("n"), V.rounded(F.avg("x")).alias("x"))


@query
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    model = cluster.cluster(tok(spark, d), ACTIVE)
    return _components(model.centroids, "raw")


@query
def cluster_corpus(spark: SparkSession, d: str) -> DataFrame:
    model = cluster.cluster(tok(spark, d), ACTIVE)
    return model.assign.groupBy("token_id", "centroid_id").agg(F.count("*").alias("n"), F.sum("dist").alias("wcss"))


@query
def kmeans_vanilla(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as one group: the baseline that ignores token ids."""
    one = cluster.cluster(tok(spark, d).withColumn("token_id", F.lit(0).cast("long")), ClusteringParams(kappa=32, mu=4, tau=8, epsilon=1, theta=1))
    return one.assign.agg(F.sum("dist").alias("wcss"))


# index


@query
def residual_norms(spark: SparkSession, d: str) -> DataFrame:
    c = cluster.mean_centroids(fine(spark, d))
    return index.residuals(fine_tokens(spark, d, c), c, DIGITS, "raw").select("doc_id", "pos", "centroid_id", V.rounded(F.col("residual_norm")).alias("residual_norm"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(fine_tokens(spark, d, cluster.mean_centroids(fine(spark, d))))


@query
def postings(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d)


@query
def posting_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).groupBy("centroid_id").agg(F.count("*").alias("n_docs"))


@query
def posting_lookup(spark: SparkSession, d: str) -> DataFrame:
    return index.posting_lists(_postings(spark, d)).where(F.col("centroid_id").isin(0, 7, 124)).select("centroid_id", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


def _codes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = fine_index(spark, d)
    one = i.doc_packs.select("doc_id", F.explode(F.sequence(F.lit(0), F.size("centroid_ids") - 1)).alias("pos"), "codes")
    return one.select("doc_id", "pos", F.expr("substring(codes, pos * 32 + 1, 32)").alias("codes")), i.codebook


@query
def pq_codebook_degenerate(spark: SparkSession, d: str) -> DataFrame:
    return fine_index(spark, d).codebook.select("m", "code", F.posexplode("sub").alias("d", "x")).select("m", "code", "d", V.rounded(F.col("x")).alias("x"))


@query
def pq_encode(spark: SparkSession, d: str) -> DataFrame:
    return pq.explode_codes(_codes(spark, d)[0])


@query
def pq_decode(spark: SparkSession, d: str) -> DataFrame:
    codes, book = _codes(spark, d)
    return pq.decode(pq.explode_codes(codes), book).select("doc_id", "pos", "d", V.rounded(F.col("x")).alias("x"))


@query
def pq_distance_table(spark: SparkSession, d: str) -> DataFrame:
    return pq.distance_table(qt(spark, d), fine_index(spark, d).codebook).select("qid", "qpos", "m", "code", V.rounded(F.col("ip")).alias("ip"))


@query
def pq_recon_error(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error of decoded unit residuals, by token id."""
    c = materialize(cluster.mean_centroids(fine(spark, d)))
    unit = index.residuals(fine_tokens(spark, d, c), c, DIGITS, "raw").select("doc_id", "pos", "centroid_id", F.posexplode("unit").alias("d", "u"))
    codes, book = _codes(spark, d)
    joined = unit.join(pq.decode(pq.explode_codes(codes), book), ["doc_id", "pos", "d"])
    return joined.groupBy("centroid_id").agg(V.rounded(F.avg((F.col("u") - F.col("x")) * (F.col("u") - F.col("x")))).alias("mse"))


@query
def pq_train(spark: SparkSession, d: str) -> DataFrame:
    c = cluster.mean_centroids(fine(spark, d))
    return pq.train(index.residuals(fine_tokens(spark, d, c), c, base="raw")).select("m", "code", F.posexplode("sub").alias("d", "x")).select("m", "code", "d", V.rounded(F.col("x")).alias("x"))


@query
def reconstruct_tokens(spark: SparkSession, d: str) -> DataFrame:
    i = fine_index(spark, d)
    rows = index.reconstruct(i.doc_packs, i.centroids, i.codebook)
    return rows.select("doc_id", "pos", F.posexplode("vec").alias("d", "x")).select("doc_id", "pos", "d", V.rounded(F.col("x")).alias("x"))


def trained_index(spark: SparkSession, d: str) -> index.Index:
    """As fine_index, with a codebook trained on all residuals."""
    centroids = materialize(cluster.mean_centroids(fine(spark, d), DIGITS))
    own = fine_tokens(spark, d, centroids)
    book = materialize(pq.train(index.residuals(own, centroids, DIGITS, "raw")))
    return index.assemble(own, centroids, book, digits=DIGITS, base="raw")


@query
def reconstruct_all(spark: SparkSession, d: str) -> DataFrame:
    """Every token, from codes of the trained codebook."""
    i = trained_index(spark, d)
    rows = index.reconstruct(i.doc_packs, i.centroids, i.codebook)
    return rows.select("doc_id", "pos", F.posexplode("vec").alias("d", "x")).select("doc_id", "pos", "d", V.rounded(F.col("x")).alias("x"))


@query
def pq_distance_all(spark: SparkSession, d: str) -> DataFrame:
    """Every query token against the trained codebook."""
    return pq.distance_table(qt(spark, d), trained_index(spark, d).codebook).select("qid", "qpos", "m", "code", V.rounded(F.col("ip")).alias("ip"))


@query
def search_trained(spark: SparkSession, d: str) -> DataFrame:
    return ranks(retrieve.search(trained_index(spark, d), qt(spark, d), SMALL))


@query
def search_built(spark: SparkSession, d: str) -> DataFrame:
    """Clusters, trains and encodes all tokens, and searches: with residuals to the centroids that are scored with."""
    p, search = fitting(spark, d)
    return ranks(retrieve.search(index.build(tok(spark, d), p), qt(spark, d), search))


def recall(tokens: DataFrame, asked: DataFrame, p: ClusteringParams, search: SearchParams) -> DataFrame:
    """base, n_queries and recall: the share of the exact ten best documents that an index finds, by what residuals are taken to."""
    exact = materialize(retrieve.top(retrieve.brute_force(asked, tokens, 10), 10))
    of, out = index.clustered(tokens, p), None
    for base in ("raw", "unit"):
        found = retrieve.search(index.build(tokens, p, base=base, of=of), asked, search)
        one = retrieve.overlap(exact, found, 10).agg(F.lit(base).alias("base"), F.count("*").alias("n_queries"), F.avg("overlap").alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


def fitting(spark: SparkSession, d: str) -> tuple[ClusteringParams, SearchParams]:
    """Parameters by which the given vectors, which are noise around ten centres, are found again: a centroid for every two vectors, and four documents in five refined."""
    n = tok(spark, d).count()
    return ClusteringParams(kappa=n // 2, mu=4, tau=8, epsilon=1, theta=1), SearchParams(kappa_c=n // 8, kappa_d=n * 4 // 50, top_k=10)


@query
def search_recall(spark: SparkSession, d: str) -> DataFrame:
    return recall(materialize(tok(spark, d)), qt(spark, d), *fitting(spark, d))


@query
def search_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each query's tokens, hits and best score, and a query without tokens, which is skipped."""
    asked = qt(spark, d)
    ids = asked.select("qid").union(spark.createDataFrame([(0,)], "qid long"))
    return retrieve.summary(ids, asked, search_topk(spark, d)).withColumn("best", V.rounded(F.col("best")))


@query
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The centroids of the documents whose number is divisible by 50, and of one that isn't there."""
    asked = emb(spark, d).select(F.expr("vec_id div 10").alias("doc_id")).where("doc_id % 50 = 0").union(spark.createDataFrame([(-1,)], "doc_id long"))
    found = index.lookup(fine_index(spark, d).doc_packs, asked)
    return found.select("doc_id", "n_tokens", F.array_join(F.transform("centroid_ids", lambda x: x.cast("string")), ",").alias("centroids"))


@query
def cluster_invariants(spark: SparkSession, d: str) -> DataFrame:
    """By token id what holds for any clustering: its budget of centroids, all of its rows in one of these, and no more scatter than around its mean (the bound)."""
    t = tok(spark, d)
    model = cluster.cluster(t, ClusteringParams(kappa=40, **MIXED))
    of = model.centroids.select("centroid_id", F.col("token_id").alias("of"))
    own = model.assign.join(of, "centroid_id", "left").groupBy("token_id").agg(F.count("*").alias("n_assigned"), F.count_if(~F.col("of").eqNullSafe(F.col("token_id"))).alias("n_outside"), F.sum("dist").alias("wcss"))
    bound = t.select("token_id", F.posexplode("vec").alias("d", "x")).groupBy("token_id", "d").agg((F.var_pop("x") * F.count("*")).alias("s")).groupBy("token_id").agg(F.sum("s").alias("bound"))
    n = of.groupBy(F.col("of").alias("token_id")).agg(F.count("*").alias("n_centroids"))
    rows = own.join(n, "token_id").join(bound, "token_id")
    return rows.select("token_id", "n_centroids", "n_assigned", "n_outside", V.rounded(F.col("bound")).alias("bound"), (F.col("wcss") <= F.col("bound") + 1e-9).cast("int").alias("within"))


@query
def pq_quality(spark: SparkSession, d: str) -> DataFrame:
    """By sub-space the mean squared error of the plain codebook (256 rows of the table as they are), and whether the one trained on all rows has no more."""
    c = materialize(cluster.mean_centroids(fine(spark, d), DIGITS))
    rest = materialize(index.residuals(fine_tokens(spark, d, c), c, DIGITS, "raw"))
    unit = rest.select("doc_id", "pos", F.posexplode("unit").alias("d", "u"))
    out = None
    for name, book in (("plain", fine_index(spark, d).codebook), ("trained", materialize(pq.train(rest)))):
        back = pq.decode(pq.explode_codes(pq.encode(rest, book)), book)
        error = unit.join(back, ["doc_id", "pos", "d"]).groupBy(F.expr("d div 2").cast("int").alias("m")).agg(F.count("*").alias("n"), F.avg((F.col("u") - F.col("x")) ** 2).alias(name))
        out = error if out is None else out.join(error.drop("n"), "m")
    return out.select("m", "n", V.rounded(F.col("plain")).alias("plain"), (F.col("trained") <= F.col("plain")).cast("int").alias("within"))


@query
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of each language without replacement, by their length: the same for every partitioning, and for every engine."""
    rows = T.read(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    top = sampling.weighted_sample(rows, 5, F.col("n").cast("double"), ["doc_id"], seed=42, by=["lang"])
    return top.select("lang", F.col("order").cast("int").alias("order"), "doc_id", V.rounded(F.col("sample_key"), 9).alias("sample_key"))


@query
def encoder_parity(spark: SparkSession, d: str) -> DataFrame:
    """Two settings of the hash encoder, doubles in stored order and floats in order of length, held against each other on all documents."""
    texts = T.read(spark, d, "documents")
    items = T.read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")

    def floats(df: DataFrame) -> DataFrame:
        return df.withColumn("vec", F.col("vec").cast("array<float>"))

    a = materialize(encode.hash_encode(texts, dim=4))
    b, again = (materialize(floats(encode.hash_encode(encode.by_length(texts.repartition(n)), dim=4))) for n in (3, 5))
    asked = materialize(encode.hash_encode(items, dim=4, key="qid").withColumnRenamed("pos", "qpos"))
    return parity.gates(a, b, again, asked, floats(asked)).select("gate", "n", F.col("ok").cast("int").alias("ok"))


@query
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Saves, loads and verifies an index; hits of the loaded one."""
    path = shared_path(spark)
    index.save(fine_index(spark, d), path)
    return ranks(retrieve.search(index.load(spark, path), qt(spark, d), SMALL))


# retrieval


@query
def centroid_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.centroid_topk(qt(spark, d), cluster.mean_centroids(fine(spark, d)), 16)
    return found.select("qid", "qpos", "centroid_id", V.rounded(F.col("sim")).alias("sim"), "rank")


@query
def centroid_topk_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same with parts of at most 20 centroids, each searched in tasks of its own."""
    found = retrieve.centroid_topk(qt(spark, d), cluster.mean_centroids(fine(spark, d)), 16, block_bytes=20 * 64 * 8)
    return found.select("qid", "qpos", "centroid_id", V.rounded(F.col("sim")).alias("sim"), "rank")


def _gathered(spark: SparkSession, d: str, kappa_c: int, best: int | None = None) -> DataFrame:
    c = materialize(cluster.mean_centroids(fine(spark, d)))
    return retrieve.gather(retrieve.centroid_packs(qt(spark, d), c, kappa_c), index.postings(fine_tokens(spark, d, c)), best)


def _scores(df: DataFrame) -> DataFrame:
    return df.select("qid", "doc_id", V.rounded(F.col("score")).alias("score"))


@query
def gather_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_gathered(spark, d, 16))


@query
def gather_all_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_gathered(spark, d, 125))


@query
def gather_in_jvm(spark: SparkSession, d: str) -> DataFrame:
    c = cluster.mean_centroids(fine(spark, d))
    return _scores(retrieve.gather_sql(qt(spark, d), c, index.postings(fine_tokens(spark, d, c)), 16))


def _at_nine(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", DIGITS))


@query
def prune_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranks(retrieve.prune(_at_nine(_gathered(spark, d, 16)), 20))


@query
def prune_alpha(spark: SparkSession, d: str) -> DataFrame:
    return ranks(retrieve.prune(_at_nine(_gathered(spark, d, 16)), 20, 0.4))


@query
def prune_alpha_guard(spark: SparkSession, d: str) -> DataFrame:
    negated = _at_nine(_gathered(spark, d, 16)).withColumn("score", -F.abs("score"))
    return ranks(retrieve.prune(negated, 20, 0.4))


@query
def refine_scores(spark: SparkSession, d: str) -> DataFrame:
    i = fine_index(spark, d)
    survivors = retrieve.prune(retrieve.gather(retrieve.centroid_packs(qt(spark, d), i.centroids, 16), i.postings, 20), 20)
    scored = _at_nine(retrieve.refine(survivors, qt(spark, d), i.doc_packs, i.centroids, i.codebook))
    return scored.select("qid", "doc_id", V.rounded_by_product(F.col("score")).alias("score"))


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranks(retrieve.search(fine_index(spark, d), qt(spark, d), SMALL))


QUERIES["search_topk"] = search_topk


@query
def search_by_graph(spark: SparkSession, d: str) -> DataFrame:
    """The same, with centroids found by graphs of a stored index, as wide as there are centroids."""
    path = shared_path(spark)
    index.save(index.with_graph(fine_index(spark, d)), path)
    return ranks(retrieve.search(index.load(spark, path), qt(spark, d), SMALL, ef=125))


@query
def search_topk_alpha(spark: SparkSession, d: str) -> DataFrame:
    return ranks(retrieve.search(fine_index(spark, d), qt(spark, d), SearchParams(16, 20, 0.4, 10)))


@query
def maxsim_bruteforce(spark: SparkSession, d: str) -> DataFrame:
    return ranks(retrieve.top(_at_nine(retrieve.brute_force(qt(spark, d), tok(spark, d))), 10))


@query
def topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    exact = retrieve.top(retrieve.brute_force(qt(spark, d), tok(spark, d), 10), 10)
    return retrieve.overlap(exact, retrieve.prune(_gathered(spark, d, 16, 20), 20).where("rank <= 10"), 10).select("qid", V.rounded(F.col("overlap")).alias("overlap"))


@query
def hnsw_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact ten nearest centroids that the graph finds."""
    c = materialize(cluster.mean_centroids(fine(spark, d)))
    exact, found = retrieve.centroid_topk(qt(spark, d), c, 10), hnsw.centroid_topk(qt(spark, d), c, 10)
    both = exact.join(found.select("qid", "qpos", "centroid_id"), ["qid", "qpos", "centroid_id"], "left_semi")
    return exact.agg(F.count("*").alias("n")).join(both.agg(F.count("*").alias("found"))).select((F.col("found") / F.col("n")).alias("recall"))


# evaluation


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.prune(_at_nine(_gathered(spark, d, 16)), 20)


@query
def mrr_at_10(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.mean_metric(_hits(spark, d), qrels(spark, d), qt(spark, d), "mrr", 10)
    return r.select("n_queries", V.rounded(F.col("quality")).alias("quality"))


@query
def success_at_5(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.mean_metric(_hits(spark, d), qrels(spark, d), qt(spark, d), "success", 5, min_rel=2)
    return r.select("n_queries", V.rounded(F.col("quality")).alias("quality"))


@query
def eval_skipped(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.skipped(qt(spark, d), qrels(spark, d).where("qid % 3 <> 0"))


def _lines(spark: SparkSession, d: str, columns: int) -> DataFrame:
    r = qrels(spark, d)
    parts = {2: ["qid", "doc_id"], 3: ["qid", "doc_id", "rel"], 4: ["qid", F.lit(0), "doc_id", "rel"]}[columns]
    return r.select(F.concat_ws("\t", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).alias("value"))


_LITERALS = ["# header\r", "901 0\r", "902\t1768\r", "", "903", "904 1 2 3 4", "905  7   2", "906 0 8 0", "907 x", "908 0 y 1", "   "]


def _with_literals(spark: SparkSession, d: str) -> DataFrame:
    own = _lines(spark, d, 3).unionAll(_lines(spark, d, 4))
    return own.unionAll(spark.createDataFrame([(x,) for x in _LITERALS], "value string"))


@query
def qrels_lenient(spark: SparkSession, d: str) -> DataFrame:
    return qrels_source.parse_lines(_with_literals(spark, d))


@query
def qrels_strict(spark: SparkSession, d: str) -> DataFrame:
    return qrels_source.parse_lines(_with_literals(spark, d), strict=True, min_rel=2)


@query
def qrels_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return qrels_source.duplicates(qrels_source.parse_lines(_with_literals(spark, d)))


@query
def latency_report(spark: SparkSession, d: str) -> DataFrame:
    """Event values as nanoseconds, by kind of event."""
    t = T.read(spark, d, "events").select("event_type", F.round(F.col("value") * 1000).cast("long").alias("total_ns"))
    return evaluate.report(t, by=("event_type",)).withColumn("avg", V.rounded(F.col("avg"), 4))


@query
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.sweep(fine_index(spark, d), qt(spark, d), qrels(spark, d), kappa_cs=(8, 16), kappa_ds=(10, 20), alphas=(None, 0.4, 0.5), min_rel=2)
    return r.select("kappa_c", "kappa_d", F.col("alpha_x100").cast("int").alias("alpha_x100"), "n_queries", V.rounded(F.col("quality")).alias("quality"))


# sources and text


@query
def qid_fallback(spark: SparkSession, d: str) -> DataFrame:
    ordinals = qt(spark, d).select((F.col("qid") - 1).alias("ordinal")).distinct()
    ids = ordinals.where("ordinal < 5").select("ordinal", (F.col("ordinal") * 100 + 100).alias("qid"))
    return T.with_query_ids(ordinals, ids)


@query
def doc_id_map(spark: SparkSession, d: str) -> DataFrame:
    ext = T.read(spark, d, "documents").select(F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("ext_id"))
    return T.id_map(ext, "ext_id")


@query
def token_validate(spark: SparkSession, d: str) -> DataFrame:
    return T.validation(tok(spark, d).where("doc_id <> 3 or pos <> 4"))


@query
def jsonl_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read back."""
    path = shared_path(spark)
    encode.write_jsonl(T.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), path)
    return encode.read_jsonl(spark, path).select("ext_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query
def encode_hash_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every document, encoded; the vectors summed up by document."""
    own = encode.hash_encode(T.read(spark, d, "documents"), dim=4)
    parts = own.select("doc_id", "token_id", F.posexplode("vec").alias("d", "x"))
    return parts.groupBy("doc_id").agg(F.count_if(F.col("d") == 0).alias("n_tokens"), F.sum(F.when(F.col("d") == 0, F.col("token_id")).otherwise(0)).alias("ids"), F.sum(F.round(F.col("x") * 1_000_000).cast("long") * (F.col("d") + 1)).alias("millionths"))


@query
def encode_keep_mask(spark: SparkSession, d: str) -> DataFrame:
    texts = T.read(spark, d, "benchmark")
    docs = encode.words(texts, key="item_id").groupBy("item_id").agg(F.count("*").alias("kept"))
    queries = encode.words(texts, key="item_id", is_query=True).groupBy("item_id").agg(F.count("*").alias("all"))
    return queries.join(docs, "item_id", "left").select("item_id", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), "all")


@query
def drop_rate(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and how many of them give no token."""
    texts = T.read(spark, d, "documents")
    return texts.agg(F.count("*").alias("n")).join(encode.dropped(texts).agg(F.count("*").alias("n_dropped")))


@query
def encode_marked(spark: SparkSession, d: str) -> DataFrame:
    """What an encoder of 32 entries is given of each document: its first words, with a marker as the second."""
    texts = encode.by_length(T.read(spark, d, "documents"))
    own = encode.marked(encode.word_list(F.col("text"), False), 32)
    return texts.select("doc_id", F.size(own).alias("n"), F.md5(F.array_join(own, " ").cast("binary")).alias("md5"))


@query
def dump_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The description of a dump, written as JSON and read back; what is the same at every run."""
    path = shared_path(spark) + "/meta.json"
    token_dump.write_metadata(token_dump.metadata(tok(spark, d), mode="docs", encoder="given"), path)
    back = spark.read.schema("format_version int, mode string, encoder string, encoder_dim int, n_docs long, n_tokens long, dropped long").json(path)
    return back.select("*")


@query
def qids_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Query ids, written as a sidecar and read back."""
    path = shared_path(spark) + "/queries.qids"
    ids = [r["qid"] * 7 for r in qt(spark, d).select("qid").distinct().orderBy("qid").collect()]  # 4 bytes a query in the file
    token_dump.write_query_ids(spark, path, ids)
    back = token_dump.read_query_ids(spark, path, len(ids))
    return spark.createDataFrame(list(enumerate(back)), "ordinal long, qid long")


@query
def sweep_csv(spark: SparkSession, d: str) -> DataFrame:
    """The cells of a timed sweep as CSV, written and read back: quality, and whether each stage has its time."""
    path = shared_path(spark)
    i, rules = stored_index(spark, d), evaluate.Protocol(slices=2, warm_up=False)
    rows = evaluate.timed_sweep(i, qt(spark, d), qrels(spark, d), f"{path}/cells", preset="msmarco_v1", kappa_cs=(8, 16), kappa_ds=(20,), alphas=(None, 0.4), min_rel=2, protocol=rules)
    evaluate.write_csv(evaluate.csv_rows(rows, dataset="given", git_sha="none"), f"{path}/csv", {"metric": "mrr at 10", "slices": "2"})
    back = spark.read.csv(f"{path}/csv", header=True)
    stages = [c for c in back.columns if c.endswith("_ms")]
    return back.select("dataset", "kappa_c", "kappa_d", "alpha_x100", "n_queries", V.rounded(F.col("quality").cast("double")).alias("quality"), sum(((F.col(c).cast("double") > 0).cast("int") for c in stages), F.lit(0)).alias("n_timed"), "git_sha")


@query
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as queries against documents, both hash-encoded: documents by the words of the query that they have."""
    return ranks(retrieve.word_search(T.read(spark, d, "documents"), T.read(spark, d, "benchmark").withColumnRenamed("item_id", "qid"), 10))


@query
def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    """As many documents as are given, made up: by token id their tokens and documents."""
    t = token_dump.synthetic(spark, docs=T.read(spark, d, "documents").count(), dim=32, vocab=16, avg_len=8, seed=20260501)
    return t.groupBy("token_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query
def token_dump_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Tokens written as a binary dump and read back."""
    path = shared_path(spark)
    token_dump.write(tok(spark, d), path)
    back = token_dump.read(spark, path)
    return back.select("doc_id", "pos", "token_id", F.posexplode("vec").alias("d", "x")).select("doc_id", "pos", "token_id", "d", V.rounded(F.col("x").cast("double")).alias("x"))
