import math
import random
import re
import zlib

import numpy as np

from pyspark.sql import functions as F

from lateloom.llm import toxicity


def brute_segments(x):
    """Maximal scoring segments by their definition: all whose proper beginnings and ends have positive sums, and that no other such one contains."""
    n = len(x)
    sums = [0.0]
    for v in x:
        sums.append(sums[-1] + v)
    good = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if all(sums[k] > sums[a] for k in range(a + 1, b + 1)) and all(sums[b] > sums[k] for k in range(a, b))]
    return sorted((a, b - 1, sums[b] - sums[a]) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good))


def test_segments():
    rng = random.Random(4)
    for _ in range(400):
        x = [rng.choice([-0.5, -0.5, -0.5, -1.25, 0.75, 1.5, 3.0]) for _ in range(rng.randint(1, 25))]
        at = [i for i, v in enumerate(x) if v != -0.5]
        got = toxicity.segments(at, [x[i] for i in at], 0.5)
        want = brute_segments(x)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(s - t) < 1e-9 for (_, _, s), (_, _, t) in zip(got, want, strict=True))


def corpus(n):
    rng = random.Random(7)
    plain, bad, stem = [f"word{i}" for i in range(300)], ["vile", "rotten", "awful"], "grumpf"
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        ws = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                ws.insert(rng.randrange(len(ws)), rng.choice([*bad, stem + rng.choice("abcdefghij") + rng.choice("klmno")]))
        docs.append((i, " ".join(ws).capitalize(), 1.0, "clash"))
        if i % 3:
            labels.append((i, toxic, 0))
    truth = {i: int(any(w in t.lower() for w in [*bad, stem])) for i, t, _, _ in docs}
    return docs, labels, truth


def test_held_out(spark):
    rows, labels, truth = corpus(1500)
    odd = [(9001, None, 1.0, "c"), (9002, "", 1.0, "c"), (None, "vile rotten awful", 1.0, "c"), (9003, "vile rotten awful " * 20000, 1.0, "c"), (9004, "İ vile rotten awful", 1.0, "c"), (1, rows[1][1], 1.0, "c")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score double, key string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1), (77777, 1, 1)], "doc_id long, toxic int, text int"))
    got = toxicity.score_documents(docs, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held and r.doc_id in truth]
    right = sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held)
    assert len(held) > 300 and right / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score < 0.1 and by[9003].score > 0.9 and by[None].score > 0.7
    assert all(0 <= r.score <= 1 for r in got)
    text = dict((r[0], r[1]) for r in rows)
    toxic = next(r for r in got if r.passages and r.doc_id in truth and truth[r.doc_id])
    assert any(w in text[toxic.doc_id][toxic.passages[0].begin : toxic.passages[0].end].lower() for w in ["vile", "rotten", "awful", "grumpf"])


def test_one_class_and_none(spark):
    rows, labels, _ = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, key string")
    for some in (spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"), spark.createDataFrame([], "doc_id long, toxic int")):
        assert toxicity.score_documents(docs, toxicity.fit(docs, some)).where(F.col("score") >= 0.7).count() == 0
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int, x int"))).count() == 0


def brute_scores(rows, labels):
    """All scores by plain definitions: features, priors, segments, extreme-value parameters, curve (by plain ascent)."""
    drift, prior, even, weight = 0.35, 1.0, 0.3, 4.0
    text = dict((r[0], r[1]) for r in rows)
    split = lambda t: re.findall(r"\w+", t.lower())
    sample = [(split(text[k]), y) for k, y, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1]
    n_toxic = sum(y for _, y in sample)
    n_clean = len(sample) - n_toxic
    seen = [({*ws, *(w[:n] + "*" for w in ws for n in range(4, 10) if n < len(w))}, y) for ws, y in sample]
    share = {}
    for f in sorted({f for own, _ in seen for f in own}, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"))):
        t, c = sum(f in own for own, y in seen if y), sum(f in own for own, y in seen if not y)
        if t < 3 or (t / n_toxic) / ((c + 0.5) / n_clean) < 3:
            continue
        stem = f.rstrip("*")
        parent = next((share[stem[:n] + "*"] for n in range(len(stem) - 1, 3, -1) if stem[:n] + "*" in share), 0.5)
        c *= n_toxic / n_clean
        q = (t + prior * parent + even) / (t + c + prior + 2 * even)
        if math.log(q / (1 - q)) >= 3 * math.sqrt(1 / (t + even) + n_toxic / n_clean / (c + even)):
            share[f] = q

    def token(w):
        known = [w, *(w[:n] + "*" for n in range(min(len(w) - 1, 9), 3, -1))]
        return next((math.log(share[f] / (1 - share[f])) for f in known if f in share), 0.0) - drift

    segments = lambda ws: [s for _, _, s in brute_segments([token(w) for w in ws])]
    clean = [token(w) for ws, y in sample if not y for w in ws]
    low, high = 1e-4, 20.0
    for _ in range(100):
        scale = (low + high) / 2
        low, high = (scale, high) if sum(math.exp(scale * s) for s in clean) < len(clean) else (low, scale)
    high = sorted(s for ws, y in sample if not y for s in segments(ws))
    least = float(np.quantile(high, 0.97))
    log_k = math.log(sum(s >= least for s in high) / len(clean)) + scale * least
    evidence = lambda ws: sum(max(0.0, scale * s - log_k - math.log(max(len(ws), 1))) for s in segments(ws))
    found = [(evidence(ws), y) for ws, y in sample]
    x, y = (np.array(v) for v in zip(*((math.log1p(e), y) for e, y in found if e > 0), strict=True))
    none = [y for e, y in found if not e]
    c, unit, w = np.where(y, weight, 1.0), x.mean(), np.zeros(2)
    a = np.stack([x / unit, np.ones_like(x)], 1)
    for _ in range(200_000):
        w -= 0.002 * (a.T @ (c * (1 / (1 + np.exp(-a @ w)) - y)) + 0.02 * w)
    curve = lambda z: 1 / (1 + math.exp(-z))
    base = math.log((sum(none) + 0.5) / (len(none) - sum(none) + 0.5))
    return {k: curve(w[0] / unit * math.log1p(e) + w[1]) if (e := evidence(split(t))) > 0 else curve(base) for k, t in text.items()}


def test_scores_are_those_of_the_definitions(spark):
    rng = random.Random(11)
    plain, bad = [f"word{i}" for i in range(25)], ["vile", "rotten", "awful", "grumpfa", "grumpfe", "grumpfi"]
    rows, labels = [], []
    for i in range(240):
        toxic = int(rng.random() < 0.4)
        ws = [rng.choice(plain) for _ in range(rng.randint(4, 18))]
        for _ in range(rng.randint(1, 3) if toxic else int(rng.random() < 0.15)):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws)))
        labels.append((i, toxic if rng.random() < 0.95 else 1 - toxic, 0))
    want = brute_scores(rows, labels)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int, x int"))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert set(got) == set(want) and 0.05 < sum(s >= 0.7 for s in want.values()) / len(want) < 0.6
    assert max(abs(got[k] - want[k]) for k in want) < 1e-3


def test_given_tables(spark):
    """Held-out labels of the largest given table that tests use: about one in sixteen of them is noise."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).where(toxicity.held_out("doc_id")).collect()}
    true = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in got}
    hits = sum(got[k] >= 0.7 for k, y in true.items() if y)
    said = sum(got[k] >= 0.7 for k in true)
    assert len(true) > 1000 and hits / sum(true.values()) >= 0.9 and hits / said >= 0.95


def test_repeated_keys_count_once(spark):
    rows, labels, _ = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, key string")
    label = spark.createDataFrame(labels, "doc_id long, toxic int, x int")
    assert toxicity.fit(docs.union(docs).union(docs), label.union(label)) == toxicity.fit(docs, label)
