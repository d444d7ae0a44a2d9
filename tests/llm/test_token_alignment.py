"""Alignment of tokenizers against plain definitions with the libraries themselves."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lateloom.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", "a b", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "x\ty  z", "a▁b", "<0x41>", "<s> </s> <unk>", "end <|endoftext|> of", "é ﬁ Ⅷ ǅ", "é", "日本語 テキスト 한국어", "🙂🙂 ok 👩‍👩‍👧", "a\x00b", "a b", "​", "　 x", "don't we'll IT'S", "1234 56.78%%% $$$", "word " * 2000, "x" * 5000, "日" * 3000, "same", "same", "﻿bom", "a\r\nb"]


def brute(texts):
    t, p = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*chars}))}
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = t.encode(" " + text, add_special_tokens=False), p.encode(text)
        of_a = [bytes(shown[c] for c in x) for x in a.tokens]
        of_b = [bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode() for i in b for s in [p.id_to_piece(i)]]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            rows.append(None)
            continue

        def ends(parts):
            at, out = 0, []
            for x in parts:
                at += len(x)
                out.append(at)
            return out

        end_a, end_b = ends(of_a), ends(of_b)
        by_end = {e: i for e, i in zip(end_b, b, strict=True)}
        shared, groups, links, k = set(end_a) & set(end_b), [], [], 0
        ours = []
        for e, i in zip(end_a, a.ids, strict=True):
            ours.append(i)
            if e in shared:
                theirs = []
                while True:
                    theirs.append(b[k])
                    k += 1
                    if end_b[k - 1] == e:
                        break
                groups.append(",".join(map(str, ours)) + "|" + ",".join(map(str, theirs)))
                links.append((i, by_end[e]))
                ours = []
        rows.append((len(a.ids), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(x for r in rows if r for x in r[3])
    most = defaultdict(int)
    for (_, j), c in n.items():
        most[j] = max(most[j], c)
    return [(k, r[0], r[1], r[2], len(r[3]), sum(n[x] == most[x[1]] for x in r[3]), sum(n[x] for x in r[3]), r[4]) if r else (k, 0, 0, 0, 0, 0, 0, "") for k, r in enumerate(rows)]


@pytest.mark.parametrize("frequent", [0, 300, 1 << 18])
def test_scores(spark, sf, monkeypatch, frequent):
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    texts = ODD + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:120]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("row", "key", "a", "b", "n", "pair", "times")})
    got = token_alignment.alignment_scores(frame, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(texts)
    assert token_alignment.alignment_scores(frame.limit(0), A, B).count() == 0


def test_align_against_shared_ends():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randrange(1, 30)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randrange(n))}) for _ in range(2))
        group_a, group_b, met = token_alignment.align(np.array(a), np.array(b))
        shared = sorted(set(a) & set(b))
        for ends, groups in ((a, group_a), (b, group_b)):
            assert groups.tolist() == [bisect.bisect_left(shared, e) for e in ends]
        assert met.tolist() == [b.index(e) if e in shared else -1 for e in a]
        index = token_alignment.IntervalIndex(b)
        lo, hi = sorted(rng.sample(range(n + 1), 2))
        first, last = index.overlapping(np.array([lo]), np.array([hi]))
        assert list(range(first[0], last[0])) == [i for i, (x, y) in enumerate(zip([0, *b[:-1]], b, strict=True)) if x < hi and y > lo]


def test_small_caches(monkeypatch):
    """What is learned again gives the same."""
    texts = [" ".join(random.Random(k).choices(["one", "twö", "three,", "日本", "x" * 100, "e"], k=9)) for k in range(30)] + ["lone \ud7ff", "a"]
    whole = token_alignment.Aligner(A, B).texts(texts)
    monkeypatch.setattr(token_alignment, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(token_alignment, "LEARN", 2)
    small = token_alignment.Aligner(A, B)
    assert [small.texts([t])[0] for t in texts] == whole == small.texts(texts) == [small.whole(t) for t in texts]
