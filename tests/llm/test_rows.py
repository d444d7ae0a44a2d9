"""Operators that work row by row: url filters, sharding, token counts, packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lateloom.llm import packing, sharding, token_counts, url_filters
from lateloom.llm.queries import RULES

DOCS = "doc_id long, text string, key string, row long, part string, n long, shard string"
ODD = ["", None, "a", " ", "  ", "a b", "a  b", "a   b ", "\n \n b", "x\n \n  y \n", "tab\tand\u00a0nbsp", "end <|endoftext|> of", "<|endoftext|>", "<|startoftext|>a", "don't we'll IT'S", "İstanbul ΣΑΣ", "日本語 テキスト 한국어", "e\u0301 \u0308x", "a\x1cb c", "\u2003em\u3000id", "1234 56.78%%% $$$", "🙂🙂 ok", "word " * 3000, "x" * 5000, "same", "same"]


def rows(texts):
    return [(i, t, "k", 1, "p", 2, "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts(sf):
    return ODD + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_urls(spark):
    urls = [None, "", "no scheme/org/", "http://a.org", "http://a.org/", "HTTP://A.ORG/x?y#z", "https://example.org/es/1", "x://sub.example.org/en/12?", "x://sub.example.org/en/2", "x://notexample.org/es/", "x://b.com/fr/", "x://com/de/1", "x://b.com/fr", "x://c.net/a#b", "x://a.org?/", "x://ÄB.org/É", "a://b.org/c://d.com/de/"]
    found = url_filters.judge_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), RULES).collect()
    assert len(found) == len(urls)
    by = {r.page_id: r for r in found}
    assert (by[0].host, by[0].path, by[0].rule, by[0].verdict) == ("", "", None, "allow")
    for r in found:
        best = brute_rule(r.host, r.path)
        assert (r.rule, r.verdict) == ((best.text, best.verdict) if best else (None, "allow")), urls[r.page_id]
    assert by[3].rule is None and by[4].rule == "org/" and by[5].host == "a.org" and by[6].verdict == "block"


def test_rules_as_a_table(spark):
    """Joined or in a trie, the same verdicts."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("ab", k=rng.randint(0, n)))
    rules = [(".".join(rng.choice(["a", "b", "A"]) for _ in range(rng.randint(1, 3))), "/" + "/".join(word(2) for _ in range(rng.randint(0, 2))), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [None, "", "x", "x://", "x://a", "x://a/?/b"] + [f"h://{'.'.join(rng.choice('abAc') for _ in range(rng.randint(1, 4)))}/{word(2)}/{word(3)}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i % 300, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    run = lambda **o: sorted(((r.page_id, r.host, r.path, (r.rule or "").lower(), r.verdict) for r in url_filters.judge_by_table(pages, table, **o).collect()), key=str)
    assert run() == run(max_chars=0) and len({r[4] for r in run()}) == 2
    assert url_filters.judge_by_table(pages.limit(0), table, max_chars=0).count() == 0
    with pytest.raises(ValueError, match="neither"):
        url_filters.judge_by_table(pages, table.withColumn("verdict", F.lit("maybe")), max_chars=0)


def test_trie_against_brute_force():
    rng = random.Random(5)
    label = lambda: rng.choice("ab")
    for _ in range(300):
        rules = {(".".join(label() for _ in range(rng.randint(1, 2))), "/" + "/".join("".join(label() for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(1, 2)))): rng.choice(["allow", "block"]) for _ in range(4)}
        trie = url_filters.RuleTrie(url_filters.Rule(h, p, v) for (h, p), v in rules.items())
        host, path = ".".join(label() for _ in range(3)), "/" + "/".join("".join(label() for _ in range(2)) for _ in range(2))
        fits = [(len(h + p), len(h), h + p) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        got = trie.longest(host, path)
        assert (got.text if got else None) == (max(fits)[2] if fits else None)
    with pytest.raises(ValueError):
        url_filters.RuleTrie([url_filters.Rule("a", "/", "maybe")])


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark, texts):
    docs = spark.createDataFrame([*rows(texts), (None, "null key", *rows([""])[0][2:]), (3, "same key", *rows([""])[0][2:])], DOCS)
    found = sharding.shard_documents(docs, 8).collect()
    assert len(found) == len(texts) + 2
    slots = defaultdict(list)
    for r in found:
        assert r.shard == slow_jump((r.doc_id or 0) % 2**64, 8) and r.grown_shard in (r.shard, 8) and r.law == "key"
        assert r.grown_shard == slow_jump((r.doc_id or 0) % 2**64, 9)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in [*enumerate(texts), (None, "null key"), (3, "same key")])
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    assert sharding.shard_documents(docs.limit(0), 8).count() == 0
    assert sharding.jump_hash(np.array([-1, 2**62]), 1).tolist() == [0, 0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, texts, name):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame(rows(texts), DOCS)
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, path, limit=50).collect()}
    count = token_counts.counter(path)
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        n = count(t or "")
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 50), t
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_packing(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(rows(texts), DOCS)
    found = packing.pack_documents(docs, path, most=64).collect()
    library = Tokenizer.from_file(path)
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (at, n) in enumerate(packing.cut(len(ids), 64)):
            want[i, k] = (at, n, zlib.crc32(ids[at : at + n].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    check_places(found, 64)
    assert len({r.sequence_id for r in found}) == packing.lower_bound(Counter(r.length for r in found), 64)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def check_places(found, most):
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= most


@pytest.mark.parametrize("part_pieces", [40, 100_000])
def test_exchange(spark, part_pieces):
    """Partitions of a few long pieces don't meet the bound on their own."""
    rng = random.Random(1)
    sizes = [rng.choice([700, 400, 330, 300, 600, 3, 1024]) for _ in range(1500)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(sizes)], "key long, piece int, start long, length long, ids_crc32 long")
    found = packing.pack(pieces, most=1024, part_pieces=part_pieces).collect()
    assert Counter(r.length for r in found) == Counter(sizes) and len({r.key for r in found}) == 1500
    check_places(found, 1024)
    whole = sum(n for _, n in packing.best_fit_decreasing({(0, s): n for s, n in Counter(sizes).items()}, 1024))
    assert len({r.sequence_id for r in found}) <= whole * 1.02 + 1


def test_exchange_of_unbalanced_halves(spark):
    """Pieces of 600 and 424 fill sequences in pairs; 16 partitions have too many of one or the other."""
    n = 60_000
    length = F.when(F.col("id") % 2 == 0, 600).otherwise(424).cast("long").alias("length")
    pieces = spark.range(n).select(F.col("id").alias("key"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), length, F.lit(7).cast("long").alias("ids_crc32"))
    found = packing.pack(pieces, most=1024, part_pieces=n // 16)
    sequences = found.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count("*").alias("n")).collect()
    assert len(sequences) == n // 2 and all((r.used, r.n) == (1024, 2) for r in sequences)


def test_best_fit_is_plain_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 60))]
        bins: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [b for b in bins if b >= s]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - s)
            else:
                bins.append(30 - s)
        got = packing.best_fit_decreasing({(0, s): n for s, n in Counter(sizes).items()}, 30)
        assert sum(n for _, n in got) == len(bins)
        assert Counter(s for items, n in got for _ in range(n) for _, s in items) == Counter(sizes)
        assert packing.lower_bound(Counter(sizes), 30) <= len(bins)
