import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from lateloom.llm import ngram_join
from lateloom.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def grams(text, size):
    raw = (text or "").encode()
    ws = WORD.findall(bytes(c + 32 if 65 <= c < 91 else c for c in raw))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) or frozenset([tuple(ws)])


def brute(rows, size, percent):
    sets = [grams(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return Counter((k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("size", "percent", "frequent"), [(4, 85, 16), (5, 80, 2)])
def test_edited_copies(spark, size, percent, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    rng = random.Random(size)
    vocab = [f"w{i}" for i in range(200)] + ["Ä", "B"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    common = text(40)
    rows = []
    for g in range(25):
        base = text(rng.choice([3, 8, 60, 150]))
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(own)
        rows += [common + text(rng.choice([5, 12, 30])) for _ in range(6)]
    rows += [base[:k] for k in range(1, 60, 3)]  # a chain
    docs = [(i, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(rows)]
    docs += [(500, None), (501, ""), (502, " \t"), (None, docs[3][1]), (None, "alone and without a key"), (7, docs[7][1]), (503, docs[7][1].upper()), (504, "one"), (505, "ONE"), (506, "x " * 5000)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1, "z", 2) for d in docs], "doc_id long, text string, n long, tag string, id int").repartition(5)
    assert found(ngram_join.jaccard_components(df, size=size, percent=percent)) == brute(docs, size, percent)


def test_given_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = found(ngram_join.jaccard_components(df))
    assert got == brute(rows, 4, 85) and len({c for _, _, c in got}) < len(rows)
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    assert set(got) == set(parent)
    assert len({(got[x], root(x)) for x in parent}) == len({root(x) for x in parent}) == len(set(got.values()))


def test_signs_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    own, other = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (50, 4000))
    h, at = np.concatenate([other, own, own]), np.cumsum([0, len(other), len(own), len(own)])
    one, two = ngram_join._signs(h, at)
    assert one[1] == one[2] == ngram_join._signs(own, np.array([0, len(own)]))[0][0] and two[1] == two[2] and one[0] != one[1]


def test_product_and_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(60, rng.integers(20, 40)).astype(np.uint64)) for _ in range(70)] + [np.arange(9000, dtype=np.uint64), np.arange(100, 9000, dtype=np.uint64)]
    linked = ngram_join.product(sets, 40)
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            n = len(np.intersect1d(x, sets[j]))
            assert linked[i, j] == (100 * n >= 40 * (len(x) + len(sets[j]) - n))
    assert linked[70, 71] and (ngram_join.product(sets[70:], 40) == linked[70:, 70:]).all()
    pairs = list(ngram_join.forest(linked))
    assert len(pairs) == len({y for _, y in pairs}) and all(x < y for x, y in pairs)


def test_hot_group_across_blocks(spark, monkeypatch):
    """Copies with edits near the bound, in many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 12)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(ngram_join.jaccard_components(df)) == brute(rows, 4, 85)
