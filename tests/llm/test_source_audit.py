"""Source audit against plain definitions."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lateloom.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    own, langs, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        found = TERM.findall(text.translate(SMALL))
        own[lang, source].update(found)
        langs[lang].update(found)
        seen[lang].update(set(found))
    out = []
    for (lang, source), counts in own.items():
        kept = [t for t in langs[lang] if seen[lang][t] >= least]

        def share(c, kept=kept):
            size = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // size for t in kept}

        mine, all_ = share(counts), share(langs[lang])
        pairs = [(s, sum((mine[t] - q) ** 2 // q for t, q in share(c).items())) for (of, s), c in own.items() if of == lang and s != source]
        words = [(t, (mine[t] - all_[t]) ** 2 // all_[t]) for t in kept if counts[t] and mine[t] > all_[t]]
        for part, items, most in (("pair", pairs, None), ("term", words, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def run(spark, docs, **parameters):
    frame = spark.createDataFrame(docs, "lang string, source string, text string").withColumns({"term": F.lit("x"), "n": F.lit(1), "value": F.lit("y"), "rank": F.lit(None)})
    return sorted(tuple(r) for r in source_audit.audit_sources(frame, **parameters).collect())


ODD = [("en", "a", None), (None, None, "x x y"), ("", "", "X z z"), ("en", None, "only here"), ("de", "b", ""), ("de", "c", "1 2 3"), ("en", "b", "Ä ä ÄB İ\x7fq r" * 3), ("en", "b", "Ä ä ÄB İ\x7fq r"), ("xx", "one", "w" * 30_000 + " " + "v " * 30_000)]


@pytest.mark.parametrize("block", [2, 512])
def test_audit(spark, monkeypatch, block):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    monkeypatch.setattr(source_audit, "GATHER", 50)
    monkeypatch.setattr(source_audit, "PAIRS", 7)
    rng = random.Random(3)
    words = [a + b for a in "abcdeÉ日" for b in ["", "x", "xy", "É", "\U0001f642"]]
    docs = ODD + [(rng.choice(["en", "de"]), rng.choice("abcde"), " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(80)]
    docs += docs[-3:]
    assert run(spark, docs, least=3, top=5) == brute(docs, 3, 5)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", "a", "b"), ("en", "c", None)]) == [("en", "a", "pair", "c", 0, 1), ("en", "c", "pair", "a", 0, 1)]


@pytest.mark.parametrize("finish", [1, 20])
def test_radix_selection(spark, finish):
    rng = random.Random(finish)
    rows = [("hot", "s", f"{'p' * rng.choice([0, 3, 200])}{x}", rng.choice([0, 7, 7, 7, 1 << 17, 10**18])) for x in range(400)]
    rows += [("few", "s", f"{x}", x) for x in range(5)] + [("tied", "s", f"long common beginning {x:05d}é{'!' * (x % 3)}", 9) for x in range(300)]
    rows += [("nested", "s", "a" * x, 1) for x in range(1, 150)]
    frame = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    got = source_audit.radix_top(frame, ["lang", "source"], 33, finish=finish).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = [(lang, "s", r[2], r[3], i) for lang, own in by.items() for i, r in enumerate(sorted(own, key=lambda r: (-r[3], r[2].encode()))[:33], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_given_tables(spark, sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet", columns=["lang", "source", "text"])
    docs = list(zip(*(c.to_pylist() for c in t.columns), strict=True))
    assert run(spark, docs) == brute(docs, 3, 200)
