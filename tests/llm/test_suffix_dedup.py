import hashlib
import os
import random
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from lateloom.llm import induced_sort, suffix_dedup


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (k, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize(("length", "gram", "split", "sort", "piece"), [(20, 6, 4096, 1 << 24, 1 << 23), (20, 5, 2, 200, 40), (33, 8, 3, 1, 100)])
def test_against_brute_force(spark, length, gram, split, sort, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(length)
    letters = "abcdefgh éß"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [text(rng.choice([length // 2, length - 1, length, length + 1, 3 * length])) for _ in range(12)]
    docs = []
    for i in range(120):
        parts = [rng.choice([text(rng.randint(0, 60)), rng.choice(pool), rng.choice(pool)[: rng.randint(1, 90)]]) for _ in range(rng.randint(0, 6))]
        docs.append((i, "".join(parts)))
    docs += [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 100), (204, "a" * (length - 1)), (205, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), (206, "x" + "a" * 60 + "y"), (207, "word " * 400)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, row long, own string").repartition(3).cache()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(suffix_dedup.remove_repeats(df, length=length, gram=gram, memory=2000)) == brute(rows, length)  # queues go to disk
    kept = suffix_dedup.remove_repeats(df, length=length, gram=gram, keep=("doc_id", "row", "own"), out="text").collect()
    assert len(kept) == len(docs) and all(len(r.kept_text.encode()) <= r.n_bytes - r.n_removed for r in kept)
    assert suffix_dedup.remove_repeats(df.limit(0), length=length, gram=gram).count() == 0


def test_given_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    got = found(suffix_dedup.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")))
    assert got == brute(rows, 200) and any(r[2] for r in got)


def test_induced_sort():
    rng = random.Random(1)
    for trial in range(200):
        depth = rng.choice([3, 8, 20])
        strings = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdefg\xff\x00") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        strings += [strings[0][:20]] * 2 + [b"a" * 30] if trial % 3 == 0 else []
        t = np.array([c for s in strings for c in [*(b + induced_sort.BYTES for b in s), induced_sort.END]] + [induced_sort.LAST], np.int16)
        order, shared = induced_sort.suffix_array(t, depth, memory=rng.choice([0, 100, 1 << 20]))
        x = t.tolist()
        keys = [x[i : i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)
        for r, k in enumerate(induced_sort.common_prefixes(t, order, depth).tolist()):
            a, b, n = order[r], order[r - 1], 0
            while r and n < depth and a + n < len(x) and b + n < len(x) and x[a + n] == x[b + n] > induced_sort.END:
                n += 1
            assert k == n == shared[r]


def test_long_passages(spark):
    """Prefixes of more than 32,767 bytes are counted."""
    rng = random.Random(2)
    common = "".join(rng.choices("abcdefgh ", k=40_500))
    rows = [(1, "one " + common), (2, common + " two"), (3, "".join(rng.choices("abcdefgh ", k=41_000)))]
    got = found(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40_000))
    assert [r[2] for r in sorted(got)] == [40_500, 40_500, 0]


def test_one_line_in_all_documents(spark, monkeypatch):
    """Slices of a line's anchor are dealt by content: no sort holds much more than SORT_BYTES, and passages beside the line that repeat are found."""
    sizes = []
    sort = suffix_dedup._sort_shard

    def noted(group, length, memory):
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").write(str(sum(len(g[5]) for g in group)))
        return sort(group, length, memory)

    folder = tempfile.mkdtemp()
    monkeypatch.setattr(suffix_dedup, "SPLIT", 20)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "_sort_shard", noted)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefgh ijklmnop", k=n))
    line = text(60)
    beside = text(200)
    rows = [(i, text(150) + line + (beside if i % 50 == 7 else text(150))) for i in range(1000)]
    got = found(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=200, gram=40))
    assert got == brute(rows, 200) and sum(r[2] > 0 for r in got) == 20
    sizes = [int(open(f"{folder}/{f}").read()) for f in os.listdir(folder)]
    assert len(sizes) > 20 and max(sizes) < 40_000  # all segments of the line together have over 350,000 bytes
