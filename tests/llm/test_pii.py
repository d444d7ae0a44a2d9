"""Personal data: plain finds against the patterns as they are written, disguised ones against planted cases."""

import hashlib
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lateloom.llm import pii
from lateloom.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def brute(text):
    return [(kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if holds(kind, m[0])]


def plain(text):
    return [s[:3] for s in pii.identifiers(text) if not s[3]]


def test_plain_against_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choices(["@", ".", "-", "+", " ", "a", "B", "1", "25", "(", ")", "é", "%", "_", "4111 1111 1111 1111", "192.168.0.1", "x@y.z"], k=rng.randrange(30)))
        assert plain(text) == brute(text), text


# text, and the parts that are to be found beside the plain ones
CASES = [
    ("write to john [at] mail [dot] example [dot] com today", [("email", "john [at] mail [dot] example [dot] com")]),
    ("john(at)mail7.example.com, thanks", [("email", "john(at)mail7.example.com")]),
    ("ask john.smith at example dot com now", [("email", "john.smith at example dot com")]),
    ("mail jane77 at example.com please", [("email", "jane77 at example.com")]),
    ("ana arroba ejemplo punto es", [("email", "ana arroba ejemplo punto es")]),
    ("jean arobase exemple point fr", [("email", "jean arobase exemple point fr")]),
    ("user_at_example_dot_com", [("email", "user_at_example_dot_com")]),
    ("john&#64;example&#x2e;com", [("email", "john&#64;example&#x2e;com")]),
    ("see jоhn@exаmple.com.", [("email", "jоhn@exаmple.com")]),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", [("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
    ("é jo​hn@example.com", [("email", "jo​hn@example.com")]),
    ("call plus one five five five, one two three four five six seven now", [("phone", "plus one five five five, one two three four five six seven")]),
    ("plus vier neun drei null eins zwei drei vier fünf sechs sieben", [("phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben")]),
    ("+1 (O17) 555-77l3", [("phone", "+1 (O17) 555-77l3")]),
    ("card four one one one one one one one one one one one one one one one ok", [("card", "four one one one one one one one one one one one one one one one")]),
    ("٤١١١ ١١١١ ١١١١ ١١١١", [("card", "٤١١١ ١١١١ ١١١١ ١١١١")]),
    ("192 dot 168 dot 1 dot 5", [("ip", "192 dot 168 dot 1 dot 5")]),
    ("at 192[.]168[.]1[.]5!", [("ip", "192[.]168[.]1[.]5")]),
    ("one nine two dot one six eight dot one dot five", [("ip", "one nine two dot one six eight dot one dot five")]),
]
CLEAN = ["look at the dot com bubble", "meet bob at home. Then go", "5 apples @ 3.50 each", "one two three, seven", "visit us at example.com", "I saw 10 or 11 at noon", "un deux trois soleil", "le point de vue", "Привет, как дела? почта", "version 1 . 2 . 3", "a (at) b", "list [.] item", "256 dot 1 dot 1 dot 999"]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_disguised(text, want):
    assert [(kind, text[b:e]) for kind, b, e, new in pii.identifiers(text) if new] == want
    around = f"Nothing. 1.2.3.4 {text} a@b.cc"
    assert [(kind, around[b:e]) for kind, b, e, new in pii.identifiers(around) if new] == want
    assert plain(around) == brute(around)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_left_alone(text):
    assert not any(s[3] for s in pii.identifiers(text))


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "one " * 50_000, "a@" * 100_000, "x at " * 50_000, "(at" * 60_000, "a_" * 100_000, " " * 200_000, "x at " + "-" * 100_000, "1 " * 100_000 + "x", "а" * 100_000, "a[at]b.com " * 10_000])
def test_long_texts_take_linear_time(text):
    begin = time.process_time()
    found = plain(text)
    assert time.process_time() - begin < 8
    if len(set(text)) > 2 or " " in text:
        assert found == brute(text[:0]) or found


def test_query(spark, sf, tmp_path):
    texts = [None, "", "same a@b.cc", "same a@b.cc", *(t for t, _ in CASES), *CLEAN, *pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"key": F.lit("x"), "spans": F.lit(None).cast("int")})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op13_pii"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        want = brute(text or "")
        r = rows[k]
        assert [r[f"n_{kind}"] for kind in PATTERNS] == [sum(s[0] == kind for s in want) for kind in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert {tuple(map(str, s)) for s in want} <= set(spans) and len(spans) == len(want) + r.n_disguised
    assert all(not rows[k].n_disguised for k in range(4 + len(CASES), len(texts)))
    assert pii.find_identifiers(frame.limit(0)).count() == 0


def test_mask(spark):
    frame = spark.createDataFrame([(1, "to bob [at] x [dot] com or +1 (017) 555-7713."), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.masked for r in pii.mask(frame).collect()} == {1: "to [email] or [phone].", 2: None}
