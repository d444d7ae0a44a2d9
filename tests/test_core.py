"""Values to check by hand, malformed input, and invariants of the approximate operators."""

import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateloom import params
from lateloom.functions import arrays, sampling, shared
from lateloom.functions import vectors as V
from lateloom.operators import blocks, budget, cluster, encode, evaluate, hnsw, index, kmeans, parity, pq, retrieve, scoring, stats
from lateloom.params import ClusteringParams, SearchParams
from lateloom.plans import catalogue
from lateloom.sources import qrels, tables, texts, token_dump


def table(spark, n, s=None):
    return spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(zip(n, s or [0.0] * len(n), strict=True))], "token_id long, n_j long, s_j double")


def column(df, name):
    return [r[name] for r in df.orderBy("token_id").collect()]


def test_rules(spark):
    assert [params.ef_search(k) for k in (15, 20, 40, 80, 100, 120, 0, 1, 3)] == [22, 30, 60, 120, 150, 180, 0, 1, 4]
    tiers = table(spark, [0, 1, 127, 128, 255, 256]).select("token_id", stats.tier(F.col("n_j"), 128, 256).alias("t"))
    assert column(tiers, "t") == ["empty", "micro", "micro", "small", "small", "active"]
    for bad in (ClusteringParams(mu=0), ClusteringParams(mu=9, tau=9), ClusteringParams(tau=100, mu=50)):
        with pytest.raises(params.InvalidThresholds):
            bad.check()
    with pytest.raises(params.KappaCZero):
        SearchParams(kappa_c=0).check()
    with pytest.raises(params.TopKExceedsKappaD):
        SearchParams(kappa_d=5, top_k=10).check()


def test_vectors(spark):
    r = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [0.0, 0.0], [2.0, 1.0, 1.0])], "a array<double>, b array<double>, z array<double>, m array<double>")
    got = r.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.l2sq(F.col("a"), F.col("b")).alias("l"), V.normalize(F.col("z")).alias("n"), V.argmin(F.col("m")).alias("i"), V.argmax(F.col("m")).alias("x"), V.cosine(F.col("a"), F.col("z")).alias("c")).first()
    assert (got.d, got.l, got.n, got.i, got.x, got.c) == (11.0, 8.0, [0.0, 0.0], 1, 0, 0.0)


def test_budget_phases(spark):
    tail = budget.tail(table(spark, range(8)), ClusteringParams(kappa=50, mu=3, tau=5))
    assert column(tail, "k_tail") == [0, 1, 1, 2, 2, 0, 0, 0] and column(tail, "left_over")[0] == 44
    p = lambda k, **o: ClusteringParams(**{"kappa": k, "mu": 3, "tau": 5, "epsilon": 4, "theta": 1} | o)
    assert column(budget.damped(table(spark, [9, 16], [2, 2]), p(70)), "k_damped") == [30, 40]
    assert column(budget.damped(table(spark, [25, 25], [1, 4]), p(100)), "k_damped") == [20, 80]
    assert column(budget.damped(table(spark, [20, 20, 20]), p(11)), "k_damped") == [4, 4, 3]
    flat = budget.damped(table(spark, [9, 16], [1, 1]), p(10))
    assert column(flat, "k_damped") == [4, 5] and [round(f, 4) for f in column(flat, "frac")] == [0.2857, 0.7143]
    every = budget.allocate(table(spark, [0, 2, 4, 20, 20, 20], [0, 0, 0, 1, 2, 3]), p(18))
    assert column(every, "kappa_j") == [0, 1, 2, 4, 4, 7]
    big = {"mu": 128, "tau": 256, "theta": 39}
    bounds = lambda rows: spark.createDataFrame([(i, n, "active", k, float(f)) for i, (n, k, f) in enumerate(rows)], "token_id long, n_j long, tier string, k_bounded long, frac float")
    assert column(budget.reconcile(bounds([(400, 4, 0.3), (400, 5, 0.8)]), p(12, **big)), "kappa_j") == [4, 8]
    assert column(budget.reconcile(bounds([(400, 10, 0.1), (400, 8, 0.6)]), p(14, **big)), "kappa_j") == [6, 8]
    assert column(budget.reconcile(bounds([(400, 10, 0.0), (400, 5, 0.9)]), p(8, **big)), "kappa_j") == [4, 4]
    with pytest.raises(params.BudgetTooLarge):
        budget.check(budget.reconcile(bounds([(156, 4, 0.1)]), p(10, **big)), p(10, **big))
    with pytest.raises(params.BudgetTooSmall):
        budget.check(budget.allocate(table(spark, [1, 1, 4]), p(3)), p(3))


def test_kmeans():
    x = np.random.default_rng(1).normal(size=(200, 4))
    f = cluster.fit(x, 8, seed=3)
    again, dist = cluster.nearest(x, f.centroids)
    assert dist.sum() <= f.wcss + 1e-9 and set(f.assignments) == set(range(8))
    few = cluster.fit(x[:3], 5)
    assert few.wcss == 0 and (few.centroids[3:] == x[2]).all() and few.assignments.tolist() == [0, 1, 2]
    same = cluster.fit(np.ones((6, 2)), 3)
    assert same.centroids.shape == (3, 2)
    with pytest.raises(params.AllZero):
        cluster.fit(np.ones((6, 2)), 3, strict=True)
    with pytest.raises(params.KmeansBudgetTooSmall):
        cluster.fit(x, 0)
    with pytest.raises(params.EmptyVectorSet):
        cluster.fit(x[:0], 2)


def test_cluster_and_partitions(spark, sf, monkeypatch):
    """The same result for every partitioning, and in blocks of any size."""
    t = catalogue.tok(spark, sf)
    p = ClusteringParams(kappa=32, mu=4, tau=8, epsilon=1, theta=1, max_iters=5)

    def got(model):
        return sorted((r.centroid_id, r.token_id, *r.raw) for r in model.centroids.collect()), sorted((r.doc_id, r.pos, r.centroid_id, r.dist) for r in model.assign.collect())

    a = got(cluster.cluster(t.repartition(1), p))
    assert a == got(cluster.cluster(t.repartition(5), p)) and [r[0] for r in a[0]] == list(range(32))
    monkeypatch.setattr(kmeans, "BLOCK_ROWS", 7)
    monkeypatch.setattr(kmeans, "HELD", 500)
    before = shared.tables()
    model = cluster.cluster(t.repartition(3), p, task_rows=10)
    assert a == got(model) and shared.tables() - before == 2  # budgets and the result


def test_fit_of_copies(spark, monkeypatch):
    """A third of the rows are copies: no centroid is lost to them, and a token of copies alone is an error where that is asked for."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.zeros((300, 3)), rng.normal(size=(20, 3)).repeat(30, 0) * 50 + rng.normal(size=(600, 3)) * 0.1])
    rows = [(i // 10, i % 10, 1, v.tolist()) for i, v in enumerate(x)] + [(1000 + i // 10, i % 10, 2, rng.normal(size=3).tolist()) for i in range(200)]
    t = spark.createDataFrame(rows, "doc_id long, pos int, token_id long, vec array<double>")
    p = ClusteringParams(kappa=40, mu=4, tau=8, epsilon=1, theta=1, max_iters=8)
    monkeypatch.setattr(kmeans, "BLOCK_ROWS", 64)
    models = cluster.cluster(t, p, task_rows=10), cluster.cluster(t, p, task_rows=10_000)
    a, b = (sorted((r.centroid_id, *r.raw) for r in m.centroids.collect()) for m in models)
    assert a == b
    by = {r.token_id: r for r in models[0].assign.groupBy("token_id").agg(F.countDistinct("centroid_id").alias("used"), F.sum("dist").alias("wcss"), F.count("*").alias("n")).collect()}
    budgets = {r.token_id: r.kappa_j for r in models[0].budgets.collect()}
    assert budgets[1] > 21 and [by[k].n for k in (1, 2)] == [900, 200] and by[1].wcss < 60
    assert all(by[k].used == budgets[k] for k in (1, 2))
    same = t.withColumn("vec", F.array(F.lit(1.0), F.lit(2.0)))
    assert cluster.cluster(same, p, task_rows=10).centroids.count() == 40
    for rows_ in (10, 10_000):
        with pytest.raises(Exception, match="fewer vectors differ"):
            cluster.cluster(same, ClusteringParams(kappa=40, mu=4, tau=8, epsilon=1, theta=1, strict=True), task_rows=rows_)
    few = t.where("token_id = 2").limit(15)
    assert sorted(r.dist for r in cluster.cluster(few, ClusteringParams(kappa=15, mu=4, tau=8, epsilon=1, theta=1), task_rows=3).assign.collect()) == [0.0] * 15


def test_fit_is_as_good_as_plain_starts():
    """Against k-means++ starts over all rows, the best of five."""
    rng = np.random.default_rng(5)
    for n, k, dim in ((2000, 40, 8), (500, 100, 2)):
        x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] * 4 + rng.normal(size=(n, dim))
        best = np.inf
        for s in range(5):
            c = kmeans.seed_centroids(x, k, np.random.default_rng(s), False, np.ones(n))
            for _ in range(25):
                own, dist = kmeans.nearest(x, c)
                c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            best = min(best, dist.sum())
        assert kmeans.fit(x, k).wcss < 1.1 * best


def test_train_in_blocks(spark, monkeypatch):
    """One pass for all sub-spaces gives the codebook of one task for each; all rows give no greater error than a sample."""
    x = np.random.default_rng(6).normal(size=(700, 8))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "doc_id long, pos int, unit array<double>").repartition(3)
    book = lambda **o: pq.book(pq.train(df, m=4, codes=32, max_iters=5, **o))
    whole = book()
    monkeypatch.setattr(kmeans, "BLOCK_ROWS", 90)
    assert (book(task_rows=100) == whole).all()
    error = lambda w: ((pq.decode_rows(pq.encode_rows(x, w), w) - x) ** 2).mean()
    assert error(whole) <= error(book(max_train=150))


def test_many_blocks_of_centroids(spark, sf, monkeypatch):
    """Searches with blocks in tasks of their own give what one broadcast gives."""
    c, q, t = catalogue.cluster.mean_centroids(catalogue.fine(spark, sf)), catalogue.qt(spark, sf), catalogue.fine(spark, sf)
    runs = lambda: (sorted(map(tuple, retrieve.centroid_topk(q, c, 10).collect())), sorted(map(tuple, cluster.assign_nearest(t, c).collect())))
    one = runs()
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 64 * 8 * 20)
    monkeypatch.setattr(blocks, "SLICE_ROWS", 100)
    monkeypatch.setattr(blocks, "one_block", None)  # no block reaches the driver
    many = runs()
    assert [r[:3] + r[4:] for r in many[0]] == [r[:3] + r[4:] for r in one[0]] and many[1] == one[1]
    with pytest.raises(Exception, match="components"):
        retrieve.centroid_topk(q.withColumn("vec", F.slice("vec", 1, 63)), c, 10).collect()


def test_graph_parts(spark, monkeypatch):
    """Every vector twenty times, and several parts: equal centroids are one node, and the ten best are found."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = spark.createDataFrame([(i, x[i % 120].tolist()) for i in range(2400)], "centroid_id int, unit array<double>").repartition(4)
    q = spark.createDataFrame([(i, 0, rng.normal(size=16).tolist()) for i in range(30)], "qid long, qpos int, vec array<double>")
    exact = {(r.qid, r.centroid_id) for r in retrieve.centroid_topk(q, c, 30).collect()}
    for rows in (4096, 50):
        monkeypatch.setattr(hnsw, "PART_ROWS", rows)
        nodes = hnsw.graph(c, m=8, ef_build=60).cache()
        assert nodes.count() == 120 and nodes.select("part").distinct().count() == -(-120 // rows)
        found = {(r.qid, r.centroid_id) for r in hnsw.search(q, nodes, 30, ef=40).collect()}
        assert len(found) == 900 and len(found & exact) / 900 >= 0.95


def test_pq():
    x = np.random.default_rng(2).normal(size=(300, 32))
    words = np.stack([cluster.fit(x[:, m : m + 1], 256, seed=m).centroids for m in range(32)])
    codes = pq.encode_rows(x, words)
    assert ((pq.decode_rows(codes, words) - x) ** 2).mean() < 1e-3
    assert (codes == np.array([[((words[m] - r[m]) ** 2).sum(1).argmin() for m in range(32)] for r in x])).all()


def test_prune(spark):
    def run(scores, k, alpha=None, ids=None):
        df = spark.createDataFrame([(1, d, float(s)) for d, s in zip(ids or range(len(scores)), scores, strict=True)], "qid long, doc_id long, score double")
        return [(r.doc_id, r.score) for r in retrieve.prune(df, k, alpha).orderBy("rank").collect()]

    assert [s for _, s in run([1, 5, 3, 2, 4, 0.5, 6, 7], 4)] == [7, 6, 5, 4]
    assert [s for _, s in run([1, 8, 4, 10, 3, 6], 9, 0.5)] == [10, 8, 6]
    assert (len(run([10, 8, 5, 4, 3, 1], 9, 0.35)), len(run([10, 8, 5, 4, 3, 1], 9, 0.5))) == (4, 3)
    assert len(run([-1, -2, -3], 9, 0.5)) == 3 and len(run([10, 6, 1, -2, -5], 9, 0.5)) == 2 and run([1, 2], 0) == []
    assert [d for d, _ in run([1] * 5, 9, None, [42, 7, 99, 3, 17])] == [3, 7, 17, 42, 99]


def test_metrics_and_report(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (3, 30, 1)], "qid long, doc_id long, rank int")
    judged = spark.createDataFrame([(1, 11, 1), (2, 20, 1), (4, 1, 1)], "qid long, doc_id long, rel int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    assert evaluate.quality(hits, judged, asked, "mrr") == 0.75 and evaluate.quality(hits, judged, asked, "success", 1) == 0.5
    with pytest.raises(params.NoOverlap):
        evaluate.quality(hits, judged.where("qid = 4"), asked)
    with pytest.raises(params.UnknownMetric):
        evaluate.quality(hits, judged, asked, "ndcg")
    r = evaluate.report(spark.createDataFrame([(v,) for v in (20, 5, 15, 10)], "total_ns long")).first()
    assert (r.avg, r.p50, r.p95) == (12.5, 15, 20)


def test_qrels(spark, tmp_path):
    def load(text, **o):
        path = tmp_path / f"{abs(hash((text, str(o))))}.tsv"
        path.write_bytes(text.encode())
        return sorted(tuple(r) for r in qrels.load(spark, f"file://{path}", **o).collect())

    assert load("1\t0\n2\t1768\n3\t0\n") == [(1, 0, 1), (2, 1768, 1), (3, 0, 1)]
    assert load("# header\r\n1 0\r\n2\t1768\r\n") == [(1, 0, 1), (2, 1768, 1)]
    assert load("10\t100\t2\n10\t200\t1\n", min_rel=2) == [(10, 100, 2)] and load("") == [] and load("1 0\n", min_rel=2) == []
    assert load("1 0 5 1\n", strict=True) == [(1, 5, 1)]
    for bad in ("10\n", "1 2 3 4 5\n", "x 2\n", "   \n"):
        with pytest.raises(params.MalformedQrelsLine):
            load(bad)
    with pytest.raises(params.MalformedQrelsLine):
        load("1 0 1\n", strict=True)
    with pytest.raises(params.DuplicatePair):
        load("1 0\n1 0\n")


def test_token_dump(spark, tmp_path):
    raw = token_dump.to_bytes([0, 2, 2, 3], [7, 8, 9], np.array([[1, 0], [0, 1], [0.5, 0.5]]))
    (tmp_path / "a.bin").write_bytes(raw)
    rows = token_dump.read(spark, f"file://{tmp_path}/a.bin").orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.token_id, r.vec) for r in rows] == [(0, 0, 7, [1, 0]), (0, 1, 8, [0, 1]), (2, 0, 9, [0.5, 0.5])]
    assert token_dump.export(token_dump.read(spark, f"file://{tmp_path}/a.bin"), 3) == raw
    change = lambda at, b: raw[:at] + b + raw[at + len(b) :]
    for bad in (change(0, b"X"), raw[:20], raw[:-1], raw + b"0", change(12, struct.pack("<I", 5000)), change(32, b"\1"), change(len(raw) - 4, struct.pack("<f", float("nan"))), change(48, struct.pack("<Q", 9))):
        with pytest.raises(params.InvalidTokenDump):
            token_dump.parse(bad)
    assert token_dump.query_ids(3, None) == [1, 2, 3] and token_dump.query_ids(1, struct.pack("<I", 9)) == [9]
    with pytest.raises(params.QidCountMismatch):
        token_dump.query_ids(1, struct.pack("<II", 9, 8))
    with pytest.raises(params.QidCountMismatch):
        token_dump.query_ids(1, None, strict=True)


def test_dump_source(spark, sf, tmp_path):
    """One file read in eight parts, files written by tasks, documents without tokens, and damaged files."""
    t = catalogue.tok(spark, sf)
    rows = lambda df: sorted((r.doc_id, r.pos, r.token_id, tuple(r.vec)) for r in df.collect())
    want = rows(t.withColumn("vec", F.col("vec").cast("array<float>")))
    token_dump.write(t, f"file://{tmp_path}/one")
    one = token_dump.read(spark, f"file://{tmp_path}/one", docs_per_part=-(-len({r[0] for r in want}) // 8))
    assert [p.name for p in (tmp_path / "one").iterdir()] == ["part-000000.bin"] and one.rdd.getNumPartitions() == 8 and rows(one) == want
    gaps = t.where("doc_id % 7 = 3").withColumn("pos", F.col("pos").cast("int"))
    token_dump.write(gaps, f"{tmp_path}/many", docs_per_file=10)
    back = token_dump.read(spark, f"{tmp_path}/many", docs_per_part=3)
    assert len(list((tmp_path / "many").iterdir())) == 5 and rows(back) == [r for r in want if r[0] % 7 == 3]
    assert {k: v for k, v in token_dump.statistics(back).first().asDict().items()} == token_dump.statistics(gaps).first().asDict()
    with pytest.raises(params.InvalidTokenDump):
        token_dump.write(t.where("doc_id > 30"), f"{tmp_path}/none", docs_per_file=10)
    raw = (tmp_path / "one/part-000000.bin").read_bytes()
    for bad in (raw[:20], raw[:-1], raw[:12] + struct.pack("<I", 5000) + raw[16:], raw[:-4] + struct.pack("<f", float("nan")), raw[:48] + struct.pack("<Q", 1 << 40) + raw[56:]):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(Exception, match="header|dimension|length|finite|order"):
            token_dump.read(spark, f"file://{tmp_path}/bad.bin").count()
    with pytest.raises(Exception, match="can't be written"):
        token_dump.write(t.withColumn("vec", F.array(F.lit(float("inf")))), f"{tmp_path}/inf")


def test_lookup_reads_little(spark, sf, tmp_path):
    i = catalogue.fine_index(spark, sf)
    index.save(i, f"file://{tmp_path}/index", doc_parts=10)
    packs = index.load(spark, f"file://{tmp_path}/index").doc_packs
    asked = spark.createDataFrame([(3,), (3,), (17,), (10**9,), (None,)], "doc_id long")
    found = index.lookup(packs, asked)
    assert "PushedFilters: [In(doc_id, [" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {3: 10, 17: 10, 10**9: 0, None: 0}


def test_lookup_of_many(spark, sf, monkeypatch):
    packs = catalogue.fine_index(spark, sf).doc_packs
    few = sorted(map(str, index.lookup(packs, packs.select("doc_id")).collect()))
    monkeypatch.setattr(index, "LOOKUP_IDS", 2)
    assert sorted(map(str, index.lookup(packs, packs.select("doc_id")).collect())) == few


def test_words_at_line_ends(spark):
    df = spark.createDataFrame([(1, "Hello, world. Bye.\nNext!"), (2, "?! -- ..."), (3, "a.b, e.g. 1,5\tx;\n"), (4, None), (5, "." * 200_000 + "a")], "doc_id long, text string")
    got = {r.doc_id: (r.docs, r.queries) for r in df.select("doc_id", encode.word_list(F.col("text"), False).alias("docs"), encode.word_list(F.col("text"), True).alias("queries")).collect()}
    assert got[1] == (["hello", "world", "bye", "next"], ["hello", ",", "world", ".", "bye", ".", "next", "!"])
    assert got[2] == ([], list("?!--...")) and got[3][0] == ["a.b", "e.g", "1,5", "x"] and got[4] == ([], []) and len(got[5][0]) == 1
    assert {r.doc_id: r.reason for r in encode.dropped(df).collect()} == {2: "no tokens", 4: "null"}


def test_made_texts(spark, tmp_path):
    """The same for every run, and documents of one theme find each other."""
    rows = lambda: [tuple(r) for r in texts.made_texts(spark, 60).orderBy("doc_id").collect()]
    made = rows()
    assert made == rows() and made[0][0] == "doc-000" and len({r[2] for r in made}) > 50 and [r[1] for r in made[:4]] == ["garden", "train", "library", "garden"]
    encode.write_jsonl(texts.made_texts(spark, 60).select("doc_id", "text"), f"{tmp_path}/docs")
    back = encode.read_jsonl(spark, f"{tmp_path}/docs").withColumn("doc_id", F.substring("ext_id", 5, 9).cast("long"))
    asked = spark.createDataFrame([(1, "train on the line"), (2, "the rose needs pruning")], "qid long, text string")
    found = retrieve.word_search(back, asked, 5).collect()
    assert {(r.qid, r.doc_id % 3) for r in found} == {(1, 1), (2, 0)}


def test_encoder_guards(spark):
    good = spark.createDataFrame([(1, 0, 5, [1.0, 2.0])], "doc_id long, pos int, token_id long, vec array<double>")
    assert encode.checked(good, 2).count() == 1 and encode.checked(good, 2).collect()[0].vec == [1.0, 2.0]
    for bad in (good.withColumn("token_id", F.lit(-1)), good.withColumn("vec", F.array(F.lit(1.0))), good.withColumn("vec", F.array(F.lit(float("nan")), F.lit(1.0)))):
        with pytest.raises(Exception, match="faulty token"):
            encode.checked(bad, 2).collect()


def test_parity_gates_fail(spark, sf):
    """Each gate notices what it is for."""
    a = catalogue.tok(spark, sf).where("doc_id < 30")
    q = catalogue.qt(spark, sf).where("qid < 5")
    ok = lambda b, again=None, asked=None: {r.gate: r.ok for r in parity.gates(a, b, b if again is None else again, q, q if asked is None else asked, k=5).collect()}
    noise = a.withColumn("vec", F.transform("vec", lambda x: x * 0.9 + F.lit(0.05)))
    assert all(ok(a).values()) and len(ok(a)) == 5
    assert not ok(a.withColumn("token_id", F.col("token_id") + F.when(F.col("doc_id") == 3, 1).otherwise(0)))["ids"]
    assert not ok(a.where("doc_id <> 3 or pos <> 9"))["ids"]
    scaled = ok(a.withColumn("vec", F.transform("vec", lambda x: x * 1.01)))
    assert scaled["ids"] and not scaled["vectors"] and scaled["centroids"] and scaled["ranking"]
    assert not ok(a, again=noise)["runs"] and ok(a, again=noise)["vectors"]
    turned = ok(a.withColumn("vec", F.reverse("vec")))
    assert not turned["centroids"] and not turned["ranking"]


def test_timed_sweep_goes_on(spark, sf, tmp_path):
    i, q, judged = catalogue.fine_index(spark, sf), catalogue.qt(spark, sf), catalogue.qrels(spark, sf)
    o = {"kappa_ds": (20,), "min_rel": 2, "protocol": evaluate.Protocol(slices=2, warm_up=False)}
    path = f"file://{tmp_path}/cells"
    first = evaluate.timed_sweep(i, q, judged, path, kappa_cs=(8,), alphas=(None,), **o).collect()
    both = evaluate.timed_sweep(i, q, judged, path, kappa_cs=(8, 16), alphas=(None,), **o).collect()
    assert len(first) == 1 and len(both) == 2 and first[0] in both  # the finished cell wasn't run again
    want = {(r.kappa_c, r.quality) for r in evaluate.sweep(i, q, judged, kappa_cs=(8, 16), kappa_ds=(20,), alphas=(None,), min_rel=2).collect()}
    assert {(r.kappa_c, r.quality) for r in both} == want
    assert all(r.avg_total_ms > 0 and r.p50_total_ms <= r.p95_total_ms and min(r.avg_gather_ms, r.avg_prune_ms, r.avg_table_ms, r.avg_refine_ms) > 0 for r in both)
    with pytest.raises(KeyError):
        evaluate.timed_sweep(i, q, judged, path, preset="other")
    with pytest.raises(params.NoOverlap):
        evaluate.timed_sweep(i, q, judged.where("qid < 0"), path, **o)


def test_weighted_samples(spark):
    """The same for every partitioning, prefixes of each other, and by weight."""
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("kind"), F.when(F.col("id") % 10 == 0, 9.0).when(F.col("id") % 10 == 1, 0.0).otherwise(1.0).alias("w"))
    draw = lambda n, k, by=None: [(r.kind if by else 0, r.order, r.id) for r in sampling.weighted_sample(df.repartition(n), k, F.col("w"), ["id"], seed=1, by=by).orderBy(*(by or []), "order").collect()]
    assert draw(1, 50) == draw(7, 50) == draw(3, 200)[:50] and draw(2, 20, ["kind"]) == draw(5, 20, ["kind"])
    ids = [i for _, _, i in draw(2, 600)]
    assert len(set(ids)) == 600 and not any(i % 10 == 1 for i in ids) and sum(i % 10 == 0 for i in ids) > 180  # 300 of 2,700 rows have more than half of the weight
    u = sampling.uniform(np.arange(20_000).astype(np.uint64), 3)
    assert abs(u.mean() - 0.5) < 0.01 and 0 < u.min() and u.max() < 1 and len(set(u.tolist())) == 20_000
    assert (sampling.content(np.array([[0.0, 1.0], [-0.0, 1.0], [1.0, 0.0]])) == sampling.content(np.array([[0.0, 1.0]]))).tolist() == [True, True, False]


def test_validate(spark, sf):
    t = catalogue.tok(spark, sf)
    assert tables.validate(t)["n_tokens"] == t.count()
    with pytest.raises(params.InvalidTokenDump):
        tables.validate(t.where("pos <> 3"))
    with pytest.raises(params.EmptyTokenDump):
        tables.validate(t.limit(0))


def test_index_is_verified(spark, sf, tmp_path):
    i = catalogue.fine_index(spark, sf)
    path = f"file://{tmp_path}/index"
    index.save(i, path)
    with pytest.raises(params.IndexExists):
        index.save(i, path)
    assert index.load(spark, path).postings.count() == i.postings.count()
    with pytest.raises(params.NoGraph):
        retrieve.search(i, catalogue.qt(spark, sf), catalogue.SMALL, ef=10)
    index.save(index.with_graph(i), f"{path}-graph")
    again = index.load(spark, f"{path}-graph")
    assert again.graph.agg(F.sum(F.size("ids"))).first()[0] == i.centroids.count() and index.load(spark, path).graph is None
    i.postings.limit(1).write.mode("append").parquet(f"{path}/postings")
    with pytest.raises(params.IndexCorrupt):
        index.load(spark, path)
    with pytest.raises(params.IndexCorrupt):
        index.load(spark, f"{path}/none")


def test_built_index_finds_documents(spark, sf):
    t, q = catalogue.tok(spark, sf), catalogue.qt(spark, sf)
    i = index.build(t, catalogue.ACTIVE, base="unit")  # residuals to what is scored with: a token is rebuilt nearly exactly
    found = retrieve.search(i, q, SearchParams(kappa_c=32, kappa_d=50, top_k=10))
    exact = retrieve.top(retrieve.brute_force(q, t), 10)
    assert retrieve.overlap(exact, found, 10).agg(F.avg("overlap")).first()[0] > 0.8


def test_recall_on_a_corpus_with_themes(spark):
    """The established definition (raw) and residuals to what is scored with (unit), where a tenth of the documents is refined."""
    t = token_dump.synthetic(spark, docs=600, dim=32, vocab=60, avg_len=8, seed=7).withColumn("vec", F.col("vec").cast("array<double>")).cache()
    got = {r.base: r.recall for r in catalogue.recall(t, t.where("doc_id % 25 = 0").select(F.col("doc_id").alias("qid"), F.col("pos").alias("qpos"), "vec"), ClusteringParams(kappa=240, mu=16, tau=32, epsilon=1, theta=8), SearchParams(kappa_c=60, kappa_d=60, top_k=10)).collect()}
    assert got["unit"] >= 0.95 and got["raw"] >= 0.85


def test_recall_on_given_tables(spark, sf):
    assert {r.base: r.recall for r in catalogue.QUERIES["search_recall"](spark, sf).collect()}["unit"] >= 0.9


def test_nearest_is_exact():
    """Ties, far from the origin and with very many centroids: always the first of those with the least sum of squared differences."""
    rng = np.random.default_rng(8)
    for n, k, dim, shift in ((300, 40, 3, 0.0), (200, 5000, 20, 1e6), (50, 7, 1, -1e3)):
        x, c = np.rint(rng.normal(size=(n, dim)) * 3) + shift, np.rint(rng.normal(size=(k, dim)) * 3) + shift
        own, dist = cluster.nearest(x, c)
        d = ((x[:, None, :] - c[None]) ** 2).sum(-1)
        assert (own == d.argmin(1)).all() and (dist == d.min(1)).all()


def test_greatest():
    rng = np.random.default_rng(9)
    s = rng.integers(0, 6, (200, 40)).astype(float)
    for k in (1, 7, 39, 40, 60):
        assert (retrieve.greatest(s, k) == np.argsort(-s, 1, kind="stable")[:, :k]).all()


def test_word_search(spark, monkeypatch):
    rng = np.random.default_rng(10)
    make = lambda n, of, k: [(i, " ".join(f"w{w}" for w in rng.integers(0, of, rng.integers(0, 12)))) for i in range(n)] + [(k, None), (k + 1, "w0 " * 500)]
    docs, queries = make(300, 40, 900), make(30, 40, 70)
    got = lambda: {(r.qid, r["rank"], r.doc_id, r.score) for r in retrieve.word_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(queries, "qid long, text string"), 4).collect()}
    want = set()
    for q, t in queries:
        found = sorted((-len(set((t or "").split()) & set((u or "").split())), d) for d, u in docs)
        want |= {(q, r + 1, d, float(-s)) for r, (s, d) in enumerate(x for x in found[:4] if x[0])}
    assert got() == want
    monkeypatch.setattr(retrieve, "WORD_BLOCK", 25)
    assert got() == want


def test_report_by_ranges(spark):
    rng = np.random.default_rng(11)
    rows = [(str(i % 3), float(v)) for i, v in enumerate(rng.integers(0, 50, 1000))]
    df = spark.createDataFrame([*rows, ("0", None)], "kind string, total_ns double").repartition(7)
    for by, groups in (((), [[v for _, v in rows]]), (("kind",), [[v for k, v in rows if k == x] for x in "012"])):
        for r, own in zip(evaluate.report(df, by=by).orderBy(*by, "n").collect(), groups, strict=True):
            own.sort()
            assert (r.n, r.p1, r.p50, r.p95, r.p99, r.min, r.max) == (len(own), *(own[min(len(own) * p // 100, len(own) - 1)] for p in (1, 50, 95, 99)), own[0], own[-1])
    assert evaluate.report(df.limit(0)).first().n == 0


def test_search_guards(spark, sf):
    i, q = catalogue.fine_index(spark, sf), catalogue.qt(spark, sf)
    with pytest.raises(params.DimMismatch):
        retrieve.search(i, q.withColumn("vec", F.slice("vec", 1, 63)), catalogue.SMALL)
    hits, times = evaluate.timed(i, q, catalogue.SMALL)
    assert {tuple(r) for r in hits.select("qid", "doc_id", "rank").collect()} == {tuple(r) for r in retrieve.search(i, q, catalogue.SMALL).select("qid", "doc_id", "rank").collect()}
    assert set(times) == {"gather", "prune", "refine", "total"}
    assert evaluate.repeated(i, q, catalogue.SMALL, iters=2, warm_up=0).count() == 2


def tied_index(spark):
    """Sixty documents with sums of 0.1, 0.2 and 0.3 in six orders, which differ in the last bit by what is added last; and a query for them."""
    sims = [(1, 2, 3), (2, 1, 3), (3, 2, 1), (1, 3, 2), (3, 1, 2), (2, 3, 1)]
    centroids = spark.createDataFrame([(c, c, v, v) for c, v in enumerate([x / 10 for x in (*s, 0)] for s in sims)], "centroid_id int, token_id long, raw array<double>, unit array<double>")
    packs = spark.createDataFrame([(n + 1, [n % 6], [0.0], bytearray(2)) for n in range(60)], "doc_id long, centroid_ids array<int>, norms array<double>, codes binary")
    book = spark.createDataFrame([(m, 0, [0.0, 0.0]) for m in range(2)], "m int, code int, sub array<double>")
    queries = spark.createDataFrame([(1, i, [float(i == j) for j in range(4)]) for i in range(3)], "qid long, qpos int, vec array<double>")
    return index.Index(centroids, spark.createDataFrame([(n % 6, n + 1) for n in range(60)], "centroid_id int, doc_id long"), book, packs), queries


TIED = SearchParams(kappa_c=6, kappa_d=20, top_k=20)
FIRST = [(n, n) for n in range(1, 21)]


def ranked(hits):
    return sorted((r["rank"], r.doc_id) for r in hits.collect())


def test_equal_sums_are_equal(spark):
    i, q = tied_index(spark)
    assert ranked(retrieve.search(i, q, TIED)) == FIRST
    assert ranked(evaluate.timed(i, q, TIED)[0]) == FIRST


def test_equal_sums_with_alpha(spark):
    i, q = tied_index(spark)
    assert ranked(retrieve.search(i, q, replace(TIED, alpha=0.4))) == FIRST


def test_equal_sums_by_graph(spark):
    i, q = tied_index(spark)
    assert ranked(retrieve.search(index.with_graph(i), q, TIED, ef=6)) == FIRST


def test_equal_sums_in_a_summary(spark):
    i, q = tied_index(spark)
    hits = retrieve.search(i, q, TIED)
    assert [tuple(r) for r in retrieve.summary(q.select("qid"), q, hits).collect()] == [(1, 3, 20, 0.6)] and hits.agg(F.max("doc_id")).first()[0] == 20


def test_equal_sums_of_a_loaded_index(spark, tmp_path):
    i, q = tied_index(spark)
    index.save(i, f"file://{tmp_path}/index")
    assert ranked(retrieve.search(index.load(spark, f"file://{tmp_path}/index"), q, TIED)) == FIRST


def test_halves_by_product(spark):
    df = spark.createDataFrame([(2.0339395,), (-2.0339395,), (1.2345675,), (-0.0,)], "x double")
    assert [r[0] for r in df.select(V.rounded_by_product(F.col("x"))).collect()] == [2.033939, -2.033939, 1.234568, 0.0]


def test_large_numbers_by_product(spark):
    """Beyond a long, and not finite, they stay as they are."""
    x = [3e15, -1e30, 1e305, float("inf"), float("-inf"), None]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(V.rounded_by_product(F.col("x"))).collect()] == x


@pytest.fixture
def halved(spark, monkeypatch):
    """The catalogue's index has three documents, whose scores are halves of the sixth digit for one query; decimals round the first and last away from zero."""
    unit = [[x, 0.0] for x in (2.0339395, 1.2345675, -2.0339395)]
    centroids = spark.createDataFrame([(c, c, v, v) for c, v in enumerate(unit)], "centroid_id int, token_id long, raw array<double>, unit array<double>")
    packs = spark.createDataFrame([(c + 1, [c], [0.0], bytearray(1)) for c in range(3)], "doc_id long, centroid_ids array<int>, norms array<double>, codes binary")
    book = spark.createDataFrame([(0, 0, [0.0, 0.0])], "m int, code int, sub array<double>")
    i = index.Index(centroids, spark.createDataFrame([(c, c + 1) for c in range(3)], "centroid_id int, doc_id long"), book, packs)
    monkeypatch.setattr(catalogue, "fine_index", lambda *_: i)
    monkeypatch.setattr(catalogue, "qt", lambda *_: spark.createDataFrame([(1, 0, [1.0, 0.0])], "qid long, qpos int, vec array<double>"))
    return lambda name: sorted(tuple(r) for r in catalogue.QUERIES[name](spark, "").collect())


HALVES = [(1, 1, 1, 2.033939), (1, 2, 2, 1.234568), (1, 3, 3, -2.033939)]


def test_halves_by_graph(halved):
    assert halved("search_by_graph") == HALVES


def test_halves_with_alpha(halved):
    assert halved("search_topk_alpha") == HALVES[:2]


def test_halves_of_a_loaded_index(halved):
    assert halved("index_roundtrip") == HALVES


def test_halves_in_a_summary(halved):
    assert halved("search_summary") == [(0, 0, 0, None), (1, 1, 3, 2.033939)]


def test_means_that_are_halves(spark):
    """7.5e-09 and 1.63565e-05 times a billion are just below a half."""
    rows = spark.createDataFrame([(1, 0, 5, [7.5e-09, 1.63565e-05, -7.5e-09])], "doc_id long, pos int, token_id long, vec array<double>")
    assert cluster.mean_centroids(rows).first()["raw"] == [7e-09, 1.6356e-05, -7e-09]


def test_norms_that_are_halves_in_a_loaded_index(spark, tmp_path):
    tokens = spark.createDataFrame([(1, 0, 0, [7.5e-09, 0.0]), (1, 1, 0, [0.0, -1.63565e-05])], "doc_id long, pos int, centroid_id int, vec array<double>")
    centroids = spark.createDataFrame([(0, 0, [0.0, 0.0], [0.0, 0.0])], "centroid_id int, token_id long, raw array<double>, unit array<double>")
    book = spark.createDataFrame([(0, 0, [0.0, 0.0])], "m int, code int, sub array<double>")
    index.save(index.assemble(tokens, centroids, book, digits=9, base="raw"), f"file://{tmp_path}/index")
    assert index.load(spark, f"file://{tmp_path}/index").doc_packs.first()["norms"] == [7e-09, 1.6356e-05]


def test_scores_that_are_halves_of_the_ninth_digit(spark):
    """1 / 1024 goes up, as in the SQL's engine, and not to the even digit: so both documents are equal, and the least id is first."""
    unit = [[1 / 1024, 0.0], [0.000976563, 0.0]]
    centroids = spark.createDataFrame([(c, c, v, v) for c, v in enumerate(unit)], "centroid_id int, token_id long, raw array<double>, unit array<double>")
    packs = spark.createDataFrame([(c + 1, [c], [0.0], bytearray(1)) for c in range(2)], "doc_id long, centroid_ids array<int>, norms array<double>, codes binary")
    book = spark.createDataFrame([(0, 0, [0.0, 0.0])], "m int, code int, sub array<double>")
    i = index.Index(centroids, spark.createDataFrame([(c, c + 1) for c in range(2)], "centroid_id int, doc_id long"), book, packs)
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "qid long, qpos int, vec array<double>")
    hits = retrieve.search(i, q, SearchParams(kappa_c=2, kappa_d=2, alpha=None, top_k=1))
    assert [r["doc_id"] for r in hits.collect()] == [1]
    assert [tuple(r) for r in retrieve.summary(q.select("qid"), q, hits).collect()] == [(1, 1, 1, 0.000976563)]


def test_numpy_rounds_as_the_columns_do(spark):
    x = [7.5e-09, -1.63565e-05, 1 / 1024, -3 / 1024, 5 / 1024, -0.0, 1e305, float("inf"), float("-inf"), 2.0339395, 4503599.627370497, 0.0]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(V.rounded_by_product(F.col("x"), 9)).collect()]
    assert arrays.rounded(np.array(x)).tolist() == want and want[2:5] == [0.000976563, -0.002929688, 0.004882813]


def test_refined_scores_are_rounded_as_in_sql(spark, sf, monkeypatch):
    """First to nine digits, as scores are ordered, and then to six."""
    monkeypatch.setattr(retrieve, "refine", lambda *_, **__: spark.createDataFrame([(1, 2, 1.2345674999999)], "qid long, doc_id long, score double"))
    assert catalogue.QUERIES["refine_scores"](spark, sf).first()["score"] == 1.234568


def test_brute_force_in_slices(spark, monkeypatch):
    """Slices of queries, runs of documents, copies of vectors and documents without a query: always each pair's score, or the best of each query."""
    rng = np.random.default_rng(12)
    kinds = rng.normal(size=(9, 3))
    docs = [(d, p, kinds[k].tolist()) for d in range(70) for p, k in enumerate(rng.integers(0, 9, rng.integers(1, 6)))]
    asked = [(q, p, kinds[k].tolist()) for q in range(40) for p, k in enumerate(rng.integers(0, 9, 3))]
    group = lambda rows: {k: np.array([v for i, _, v in rows if i == k]) for k in {r[0] for r in rows}}
    want = {(q, d): round(float((x @ y.T).max(1).sum()), 6) for q, x in group(asked).items() for d, y in group(docs).items()}
    t, a = spark.createDataFrame(docs, "doc_id long, pos int, vec array<double>").repartition(3), spark.createDataFrame(asked, "qid long, qpos int, vec array<double>")
    first = {q: sorted((-s, d) for (p, d), s in want.items() if p == q)[:4] for q in range(40)}
    for tokens in (1 << 14, 7):
        monkeypatch.setattr(scoring, "SLICE_TOKENS", tokens)
        assert {(r.qid, r.doc_id): round(r.score, 6) for r in retrieve.brute_force(a, t).collect()} == want
        got = retrieve.top(retrieve.brute_force(a, t, 4, 6), 4).collect()
        assert {q: sorted((-r.score, r.doc_id) for r in got if r.qid == q) for q in range(40)} == first


def test_gather_in_parts(spark, monkeypatch):
    """The best centroid of each document and token, added up, in any parts; with best, the first of each query by score and id."""
    rng = np.random.default_rng(13)
    posted = {(int(c), int(d)) for c, d in zip(rng.integers(0, 12, 150), rng.integers(0, 40, 150), strict=True)}
    hits = [(q, p, int(c), float(s), i + 1) for q in range(15) for p in range(3) for i, (c, s) in enumerate(zip(rng.permutation(14)[:6], -np.sort(-rng.integers(-9, 9, 6) / 8), strict=True))]
    best = {}
    for q, p, c, s, _ in hits:
        for d in (d for k, d in posted if k == c):
            best[q, p, d] = max(best.get((q, p, d), -9.0), s)
    want = {}
    for (q, _, d), s in best.items():
        want[q, d] = want.get((q, d), 0.0) + s
    h, p = spark.createDataFrame(hits, "qid long, qpos int, centroid_id int, sim double, rank int"), spark.createDataFrame(sorted(posted), "centroid_id int, doc_id long")
    for postings in (1 << 22, 20):
        monkeypatch.setattr(scoring, "PART_POSTINGS", postings)
        assert {(r.qid, r.doc_id): r.score for r in retrieve.gather(h, p).collect()} == want
        got = retrieve.prune(retrieve.gather(h, p, 3), 3).collect()
        assert {(r.qid, r["rank"], r.doc_id, r.score) for r in got} == {(q, r + 1, d, -s) for q in range(15) for r, (s, d) in enumerate(sorted((-s, d) for (k, d), s in want.items() if k == q)[:3])}


def test_refine_of_few_and_many(spark, sf):
    """A few candidates, or nearly all, give the same scores, and the best of each query."""
    i, q = catalogue.fine_index(spark, sf), catalogue.qt(spark, sf)
    pairs = q.select("qid").distinct().join(i.doc_packs.select("doc_id"))
    many = {(r.qid, r.doc_id): round(r.score, 9) for r in retrieve.refine(pairs, q, i.doc_packs, i.centroids, i.codebook).collect()}
    few = {(r.qid, r.doc_id): round(r.score, 9) for r in retrieve.refine(pairs.where("(qid + doc_id) % 10 = 0"), q, i.doc_packs, i.centroids, i.codebook).collect()}
    assert len(many) == 500 and len(few) == 50 and all(abs(many[k] - v) < 1e-8 for k, v in few.items())
    top = lambda df: {(r.qid, r["rank"], r.doc_id) for r in retrieve.top(retrieve.rounded(df), 3).collect()}
    args = (pairs.where("qid <> doc_id"), q, i.doc_packs, i.centroids, i.codebook)
    assert top(retrieve.refine(*args)) == top(retrieve.refine(*args, best=3))


def test_cosines_of_odd_vectors(spark):
    """Every pair has its row: long ids, zero vectors, and those that are null, shorter or hold null."""
    rows = [(1 << 40, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [-2.0, 1.0]), (4, None), (5, [1.0]), (6, [None, 1.0]), (7, [3.0, 1.0])]
    a, b = (spark.createDataFrame(rows, f"{c}_id long, {c} array<float>") for c in "ab")
    want = {tuple(r) for r in a.join(b).select("a_id", "b_id", V.rounded(V.cosine(F.col("a"), F.col("b")))).collect()}
    assert {tuple(r) for r in blocks.cosines(b, a, 6).collect()} == want and len(want) == 49


def test_sweep_reads_a_stored_index(spark, sf, monkeypatch):
    """Each timed search reads the index; none encodes the documents again."""
    seen = []
    monkeypatch.setattr(evaluate, "timed_sweep", lambda i, *_, **__: seen.append(i) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalogue.QUERIES["sweep_csv"](spark, sf)
    files = [*seen[0].doc_packs.inputFiles(), *seen[0].postings.inputFiles()]
    assert files and not any("embeddings" in f for f in files)


def test_recall_clusters_once(spark, sf, monkeypatch):
    calls, real = [], cluster.cluster
    monkeypatch.setattr(index.clustering, "cluster", lambda *a: calls.append(1) or real(*a))
    t = catalogue.tok(spark, sf).where("doc_id < 12")
    catalogue.recall(t, catalogue.qt(spark, sf).where("qid < 3"), ClusteringParams(kappa=20, mu=4, tau=8, epsilon=1, theta=1), SearchParams(kappa_c=10, kappa_d=10, top_k=10))
    assert len(calls) == 1


def test_sidecars(spark, tmp_path):
    for bad in (-1, 2**32, "x", True, None):
        with pytest.raises(params.QidOutOfRange):
            token_dump.query_id_bytes([bad])
    assert token_dump.query_id_bytes([1, 2**32 - 1]) == struct.pack("<II", 1, 2**32 - 1)
    with pytest.raises(params.InvalidTokenDump):
        token_dump.metadata(spark.range(0), mode="other", encoder="x")
    i = spark.createDataFrame([(1, 0, 5, [1.0, float("nan")]), (2, 0, -5, [1.0, 1.0]), (3, 0, 5, [1.0]), (4, 0, 5, [1.0, 2.0])], "doc_id long, pos int, token_id long, vec array<double>")
    assert {tuple(r) for r in encode.faulty(i, 2).collect()} == {(1, "not finite"), (2, "id"), (3, "dim")}


def test_marked(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c", "d"],)], "w array<string>")
    assert [r[0] for r in df.select(encode.marked(F.col("w"), 4)).collect()] == [[], ["a", "[D]"], ["a", "[D]", "b", "c"]]


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1024, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(x, m=32, ef_build=400)
    hit = 0
    for q in rng.normal(size=(16, 64)):
        hit += len({v for _, v in g.search(q, 10, 60)} & set(np.argsort(-(x @ q))[:10].tolist()))
    assert hit / 160 >= 0.9 and g.search(x[0], 0) == []


def test_drops(spark):
    texts = spark.createDataFrame([(1, "a word."), (2, " . "), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.reason for r in encode.dropped(texts).collect()} == {2: "no tokens", 3: "null"}
    with pytest.raises(params.DropRateExceeded):
        encode.check_drops(texts)
    assert encode.check_drops(texts, allow=True, max_rate=0.7) > 0.6


def test_stream(spark, sf, tmp_path):
    from lateloom.streaming.queries import search_stream

    q = catalogue.qt(spark, sf)
    q.write.parquet(f"{tmp_path}/in")
    got = []
    i = catalogue.fine_index(spark, sf)
    s = search_stream(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/in"), i, catalogue.SMALL, lambda df, n: got.extend(df.collect()), f"{tmp_path}/check")
    s.processAllAvailable()
    s.stop()
    assert {(r.qid, r.doc_id) for r in got} == {(r.qid, r.doc_id) for r in retrieve.search(i, q, catalogue.SMALL).collect()}


def test_whole_queries(spark, sf):
    tokens, queries = catalogue.tok(spark, sf), catalogue.qt(spark, sf)
    n = tokens.count()
    assert catalogue.QUERIES["reconstruct_all"](spark, sf).count() == 64 * n
    assert catalogue.QUERIES["pq_distance_all"](spark, sf).count() == queries.count() * 32 * 256
    assert catalogue.QUERIES["vec_dot"](spark, sf).count() == -(-n // 50) * n
    found = catalogue.QUERIES["search_trained"](spark, sf).groupBy("qid").count().collect()
    assert len(found) == queries.select("qid").distinct().count() and all(r["count"] == 10 for r in found)
