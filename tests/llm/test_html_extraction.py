import html
import itertools
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from lateloom.llm import html_extraction
from lateloom.llm.html_blocks import leaf_blocks
from lateloom.llm.labelled_pages import labelled_page


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &lt;text&gt;", ["plain <text>"]),
        ("<p>a<p>b &amp;amp; <b>c</b>d", ["a", "b &amp; cd"]),
        ("<p>one<br>two\n three</p>", ["one two three"]),
        ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes<!-- <p>no -->!</p>", ["yes!"]),
        ("<p title='a>b'>x < y &copy 1 &#x41;&nbsp;&eacute;</p>", ["x < y © 1 A é"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<a href=x>l</a> t </span></div><p></p>  <p> </p>", ["l t"]),
        ("<title>t &amp; <b></title><textarea><p>q</textarea>", ["t & <b>", "<p>q"]),
        ("<p>unclosed <b", ["unclosed <b"]),
        ("<!-- open <p>no", []),
    ],
)
def test_leaf_blocks(page, want):
    assert [b.text for b in leaf_blocks(page)] == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p><svg width=1 /><p>b</p><svg><text>no</text></svg><p>c</p>", ["a", "b", "c"]),
        ("<p>a <math/>b</p><p>c</p>", ["a b", "c"]),
        ("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["where x=1 holds"]),
        ("<video-player>a</video-player><object-card>b</object-card><p>c", ["a", "b", "c"]),
        ("<title-bar>a</title-bar><p>b", ["a", "b"]),
        ("<xmp>a <b> &amp;</xmp><p>c", ["a <b> &amp;", "c"]),
        ("<p>a</p><video src=x><p>b</p>", ["a", "b"]),
        ("<video>no</video ><object data=x/><p>a</p><object>no</object><script/>no</script x><p>b", ["a", "b"]),
    ],
)
def test_text_beside_opaque_elements(page, want):
    assert [b.text for b in leaf_blocks(page)] == want


def test_viterbi_against_all_labellings():
    rng = random.Random(1)
    for _ in range(200):
        f = html_extraction.Field({}, tuple(tuple(rng.uniform(-2, 2) for _ in range(2)) for _ in range(2)), 0.0)
        scores = [rng.uniform(-3, 3) for _ in range(rng.randint(0, 8))]
        value = lambda y: sum(s * v for s, v in zip(scores, y, strict=True)) + sum(f.moves[a][b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert abs(value(f.labels(scores)) - value(best)) < 1e-9


def test_held_out_pages():
    field = html_extraction.default_field()
    right = total = 0
    for seed in range(100_000, 100_200):
        page, labels = labelled_page(seed)
        blocks = leaf_blocks(page)
        assert len(blocks) == len(labels)
        scores = [field.bias + sum(field.weights.get(x, 0) for x in (*c, *o)) for c, o in html_extraction.block_features(blocks)]
        right += sum(a == b for a, b in zip(field.labels(scores), labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", inner))).split("\0")
    return " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)


def test_given_pages(spark, sf):
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    want = {r["page_id"]: article(r["html"]) for r in rows}
    got = html_extraction.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(got) == len(rows)
    assert sum(r.text == want[r.page_id] for r in got) / len(got) > 0.99
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_pages(spark):
    long = "<html><body><article>" + "<p>A sentence of the text.</p>" * 5000 + "</article></body></html>"
    rows = [(1, None, None, "x", 1), (2, "u", "", "x", 1), (3, "u", "<nav><ul><li><a href=x>Menu</a></ul></nav>", "x", 1), (4, "u", long, "x", 1), (4, "u", long, "x", 1), (None, "u", "<p>" * 3000, "x", 1), (5, "u", "<div>" * 5000 + "deep", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extraction.extract_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[3] == "" and by[4].count("sentence") == 5000
    assert html_extraction.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a", "</title ", "<svg>", "<div>", "<div class=a>", "<!--", "</svg ", "<a '>\"", "<li>", "<title><"])
def test_malformed_pages_take_linear_time(part):
    begin = time.process_time()
    leaf_blocks(part * (1_000_000 // len(part)))
    leaf_blocks("<p>text<title>" + part * (500_000 // len(part)) + '">')
    assert time.process_time() - begin < 10


def test_unclosed_markup():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("one <a two") == ["one <a two"]
    assert texts("<p>1 < 2 <b>and</b> 3 > 2") == ["1 < 2 and 3 > 2"]
    assert texts('<p>one</p><p title="a > b">two') == ["one", "two"]
    assert texts("one</p two") == ["one"]
    assert texts("<title>one</title two") == ["one</title two"]
    assert texts("one<!-- two") == ["one"] and texts("one<script>two") == ["one"] and texts("one<!x>two") == ["onetwo"]
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == ["deep", "after"]


def test_many_names_and_deep_pages():
    begin = time.process_time()
    page = f'<div class="{" ".join(f"name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}x" for i in range(40_000))}">' + "<p>word one</p>" * 60_000
    text = html_extraction.default_field().extract(page)
    assert len(leaf_blocks(page)) == 60_000 and isinstance(text, str)
    for part in ("<b>", "<hr>", "<td>", "</i>", "<div><b>", "<option>"):
        leaf_blocks("<b>" * 100_000 + part * 100_000 + "x")
    assert time.process_time() - begin < 30
    inside = leaf_blocks('<div class="sidebar">' + "<div>" * 600 + "</div>" * 600 + "<p>in the sidebar</p></div><p>after")
    assert "name:sidebar" in set(inside[0].context) and "name:sidebar" not in set(inside[1].context)


def _prose(k, n=3):
    words = "the river carried old boats past quiet houses while people watched from bridges and spoke of weather trade and distant towns".split()
    rng = random.Random(k)
    return " ".join(" ".join(rng.choices(words, k=rng.randint(9, 18))).capitalize() + "." for _ in range(n))


MAIN = [_prose(k) for k in range(6)]
JUNK = ["Log in", "Home", "About us", "Contact", "Privacy policy", "Terms of use", "Subscribe now", "Next page"]
_links = lambda names: "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names)
_paragraphs = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
#: Layouts that the generator of labelled pages doesn't make, written by hand.
LAYOUTS = {
    "hashed classes": f'<div class="css-1a2b3c"><div class="css-9f8e7d"><ul>{_links(JUNK[:4])}</ul></div><div class="css-77aa01"><h1>Boats on the river</h1>{_paragraphs(MAIN)}</div><div class="css-0c0c0c"><ul>{_links(JUNK[4:])}</ul></div></div>',
    "hashed, divs only": f'<div class="x1"><div class="x2"><a href="/">Home</a><a href="/a">About us</a></div><div class="x3"><div class="x4">Boats on the river</div>{"".join(f"<div class=x5>{t}</div>" for t in MAIN)}</div><div class="x6"><a href="/p">Privacy policy</a> <a href="/t">Terms of use</a></div></div>',
    "forum post": f'<div id="topbar"><ul>{_links(JUNK[:4])}</ul></div><div class="thread"><div class="postbody"><h3>Boats on the river</h3><div class="content">{MAIN[0]}<br><br>{MAIN[1]}</div><div class="content">{MAIN[2]}</div></div></div><div id="footer"><p><a href="/p">Privacy policy</a></p></div>',
    "encyclopedia": f'<div id="mw-page"><div id="mw-head"><ul>{_links(JUNK[:3])}</ul></div><div id="content"><h1 id="firstHeading">Boats</h1><div id="bodyContent"><div class="mw-parser-output">{_paragraphs(MAIN[:3])}<h2>History</h2>{_paragraphs(MAIN[3:])}</div></div></div><div id="mw-panel"><ul>{_links(JUNK[3:])}</ul></div></div>',
    "grid": f'<div class="grid"><div class="col-3"><ul>{_links(JUNK)}</ul></div><div class="col-9"><h1>Boats on the river</h1>{_paragraphs(MAIN)}</div></div>',
    "table": f'<table><tr><td><a href="/">Home</a><br><a href="/a">About us</a></td><td><h1>Boats on the river</h1>{_paragraphs(MAIN)}</td></tr><tr><td colspan="2"><a href="/p">Privacy policy</a></td></tr></table>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_that_are_not_generated(name):
    page = f"<html><head><title>t</title></head><body>{LAYOUTS[name]}</body></html>"
    text = html_extraction.default_field().extract(page)
    own = [t for t in MAIN if t in LAYOUTS[name]]
    assert [t for t in own if t not in text] == []
    assert [j for j in JUNK if j in LAYOUTS[name] and j in text] == []
