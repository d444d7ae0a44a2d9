import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from lateloom.llm import decontamination

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def grams(text, size):
    ws = WORD.findall(text.lower())
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


def brute(docs, items):
    out = []
    for i, t in items:
        size = min(5, len(WORD.findall((t or "").lower())))
        own = grams(t or "", size) if size else set()
        for d, text in docs if own else []:
            n = len(own & grams(text or "", size))
            if 100 * n >= 80 * len(own):
                out.append((d, i, len(own), n))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect())


@pytest.mark.parametrize("block", [150, 2_000_000])
def test_edited_passages(spark, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", block)
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)] + ["Ärger", "ÉTÉ", "don't"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 6, 12, 40, 90]))) for i in range(60)] + [(100, ""), (101, None), (102, "..."), (None, text(20)), (103, "w1 " * 30), (103, "w1 " * 30)]
    docs = []
    for d in range(200):
        body = text(rng.choice([0, 3, 60, 400])).split()
        for _ in range(rng.randint(0, 3)):
            passage = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if passage:
                    passage[rng.randrange(len(passage))] = rng.choice(["x", "Y!", "", passage[0].upper()])
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(body)))
    docs += [(900, None), (901, ""), (None, items[7][1]), (5, items[8][1]), (5, items[8][1]), (902, "w1 " * 4000)]
    got = found(decontamination.find_contained(spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, item_id long, size string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items) and len(got) > 100


def test_given_tables(spark, sf):
    read = lambda n, k: [(r[k], r["text"]) for r in pq.read_table(f"{sf}/{n}.parquet").to_pylist()]
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = found(decontamination.find_contained(docs, items))
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id")) and got
    assert decontamination.find_contained(docs.limit(0), items).count() == 0
    assert decontamination.find_contained(docs, items.limit(0)).count() == 0


def test_other_items_are_not_found_by_an_index_that_was_kept(spark):
    """Many calls in one session, each with items of its own."""
    for i in range(12):
        words = " ".join(f"q{i}w{k}" for k in range(9))
        docs = spark.createDataFrame([(1, f"a b c {words} d"), (2, "nothing of that kind is here at all"), (1, "no item, but the same id")], "doc_id long, text string").coalesce(1)
        items = spark.createDataFrame([(i, words), (99, " ".join(f"z{i}w{k}" for k in range(9)))], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in decontamination.find_contained(docs, items).collect()] == [(1, i)]
        assert sorted(r.text[:2] for r in decontamination.without_contained(docs, items).collect()) == ["no", "no"]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 10)
    text = lambda i: " ".join(f"i{i}w{k}" for k in range(12))
    docs = spark.createDataFrame([(i, text(i) if i % 2 else f"clean {i}") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(i)) for i in range(20)] + [(50, None), (51, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_contained(docs, items).collect()} == {(i, i) for i in range(1, 20, 2)}
    assert {r.doc_id for r in decontamination.without_contained(docs, items).collect()} == set(range(0, 20, 2))
