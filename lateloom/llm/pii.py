"""Personal data in texts: mail addresses, IP addresses, card and phone numbers, plain and disguised.

Plain ones are found by patterns in the text itself. For disguised ones a chain of transducers rewrites the text, each output
character carrying the range of source characters that it stands for: look-alikes and characters that can't be seen, character
references, spelled digits, words and brackets for @ and dots, letters among digits. The same patterns then read the rewritten
text, and what they find goes back to source characters. Only what a transducer has touched is added; plain finds stay as they are.
Texts are independent of each other: they are read once, nothing is shuffled, and texts without any sign of a disguise are not rewritten.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release

Span = tuple[int, int]

# Patterns in linear time: a digit or label is never tried from its middle, which can't match where its begin doesn't.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost, not overlapping: an @ and what follows is looked for first, then the name before it, back to the last find."""
    found, last = [], 0
    for m in _AT.finditer(text):
        begin = m.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < m.start():
            found.append((begin, last := m.end()))
    return found


def addresses(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p) < 4 and int(p) < 256 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right: from the right, every second digit counts twice."""
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[Span]:
    found = ((m.span(), m[0].replace(" ", "").replace("-", "")) for m in _CARD.finditer(text) if m.end() - m.start() >= 16)
    return [span for span, digits in found if 16 <= len(digits) <= 19 and luhn(digits)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []


def parted_cards(text: str) -> list[Span]:
    """Cards, and in runs of digits that are none, the leftmost groups of digits that follow each other and make one."""
    found = []
    for run in _CARD.finditer(text):
        groups = [(run.start() + m.start(), m[0]) for m in re.finditer("[0-9]+", run[0])]
        k = 0
        while k < len(groups):
            digits, best = "", None
            for j in range(k, len(groups)):
                digits += groups[j][1]
                if len(digits) > 19:
                    break
                if len(digits) >= 16 and luhn(digits):
                    best = j
            if best is not None:
                found.append((groups[k][0], groups[best][0] + len(groups[best][1])))
            k = k + 1 if best is None else best + 1
    return found


KINDS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}

# Characters that look like one of ASCII and that compatibility normalisation doesn't give, spelled digits and the
# like in four languages, words for @ and for a dot, usual last labels of names of hosts.
_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУԌԚԜаеіјорсухһԁԛԝѕкмтнвᴀᴄᴅᴇᴋᴍᴏᴘᴛᴜᴠᴡᴢΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχɑɡɩıⅼ。·∙•‐‑‒–—―−⁃➕⧸",
        "ABESIJKMHOPCTXYGQWaeijopcyxhdqwskmthbacdekmoptuvwzABEZHIKMNOPTYXaiknopuxagiil....--------+/",
        strict=True,
    )
)
_DIGITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_TIMES = {"double": 2, "triple": 3}
_PLUS = ("plus", "más", "mas")
_AT_WORDS = ("at", "ät", "arroba", "arobase", "klammeraffe", "chez")
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_LAST_LABELS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv uk us eu de at ch fr es it nl be pt pl se no dk fi ie ca au mx ar br cl in jp cn ru test example".split())
#: Words before a bare "at" or after it that make it one of the language.
_PROSE = frozenset("the a an this that these those it its all any every each home work least most first last once time night noon us you me him her them".split())


@lru_cache(maxsize=1 << 14)
def alike(c: str) -> str | None:
    """The character of ASCII that c looks like or stands for, nothing for one that can't be seen, None for any other."""
    if c < "\x80":
        return None
    if c in _ALIKE:
        return _ALIKE[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    if unicodedata.category(c) == "Cf" or "︀" <= c <= "️":
        return ""
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and " " <= plain < "\x7f" else None


class Rewritten:
    """A text in course of being rewritten; each character has a range of the source."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begin = np.arange(len(text), dtype=np.int64)
        self.end = self.begin + 1
        self.touched = np.zeros(len(text), bool)
        self.changed = False

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts strings in place of ranges, which don't overlap and are in order. All characters of a string stand for the whole range."""
        if not edits:
            return
        self.changed = True
        parts, last = [], 0
        keep = np.ones(len(self.text), bool)
        at, begins, ends = [], [], []
        for b, e, new in edits:
            parts += [self.text[last:b], new]
            keep[b:e] = False
            if new:
                at += [b] * len(new)
                begins += [self.begin[b]] * len(new)
                ends += [self.end[e - 1]] * len(new)
            last = e
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        places = kept_before[np.array(at, np.int64)]
        self.text = "".join(parts) + self.text[last:]
        self.begin = np.insert(self.begin[keep], places, np.array(begins, np.int64))
        self.end = np.insert(self.end[keep], places, np.array(ends, np.int64))
        self.touched = np.insert(self.touched[keep], places, np.ones(len(places), bool))

    def source(self, begin: int, end: int) -> Span | None:
        """The source of a range; None where nothing in it has been rewritten."""
        if not self.touched[begin:end].any() and int(self.end[end - 1] - self.begin[begin]) == end - begin:
            return None
        return int(self.begin[begin]), int(self.end[end - 1])


def _any(words: tuple[str, ...] | dict[str, int]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_FLAGS = re.IGNORECASE
_DIGIT, _TIME, _A, _D = _any(_DIGITS), _any(_TIMES), _any(_AT_WORDS), _any(_DOT_WORDS)
#: Three or more spelled digits (figures may stand between) in a row.
_RUN = re.compile(rf"\b(?:{_any(_PLUS)}[ ,-]{{1,2}})?(?:{_TIME} )?{_DIGIT}\b(?:(?:[ ,.()-]{{1,3}}|[ ,]+{_D}[ ,]+)(?:[0-9]+\b|(?:{_TIME} )?{_DIGIT}\b))+", _FLAGS)
_ITEM = re.compile(rf"({_any(_PLUS)})[ ,-]{{1,2}}|(?:({_TIME}) )?\b({_DIGIT})\b|([0-9]+)", _FLAGS)
_REFERENCE = re.compile(r"&#(?:0*(?:64|46|43|45)|x0*(?:40|2e|2b|2d));|&(?:commat|period|plus);|%40|%2e", _FLAGS)
_REFERRED = {"commat": "@", "period": ".", "plus": "+", "%40": "@", "%2e": "."}
_BRACKETED = re.compile(rf"(?<![ \t])[ \t]*+[\[({{<][ \t]*(?:(@|{_A})|(\.|{_D}))[ \t]*[\])}}>][ \t]*", _FLAGS)
_LABEL = r"[A-Za-z0-9-]+"
_BARE = re.compile(rf"(?<![^\s(\[<:;,\"'])([A-Za-z0-9._%+-]+)([ \t]+{_A}[ \t]+|[ \t]*@[ \t]*|[_-]{{1,3}}at[_-]{{1,3}})({_LABEL}(?:(?:[ \t]+{_D}[ \t]+|[_-]{{1,3}}dot[_-]{{1,3}}|[ \t]\.[ \t]|\.){_LABEL})+)", _FLAGS)
_DOTS = re.compile(rf"[ \t]+{_D}[ \t]+|[_-]{{1,3}}dot[_-]{{1,3}}|[ \t]\.[ \t]", _FLAGS)
_BETWEEN = re.compile(rf"(?<=[0-9])(?:[ \t]+{_D}[ \t]+|[ \t]\.[ \t]|[ \t]*,?[ \t]+{_D},?[ \t]+)(?=[0-9])", _FLAGS)
#: Letters that stand for figures: in a run that is mostly of figures.
_FIGURES = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl|](?:[ .()-]{0,2}[0-9OoIl|]){7,}(?![A-Za-z0-9])")
_FIGURE = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}
# What a disguise can't do without, in a lower-cased text; each begins with a few characters, so that a search is quick.
_SPELLED = re.compile(rf"{_DIGIT}\b[ ,.()-]{{1,3}}(?:{_TIME} )?{_DIGIT}\b")
#: Spelled digits in UTF-8, and bytes of texts with A-Z lower-cased and marks parting words.
_DIGIT_BYTES = frozenset(w.encode() for d in _DIGITS for w in (d, re.sub("[^a-z]", lambda m: m[0].upper(), d)))
_PARTED = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in bytes(range(256)).lower())
_SIGNS = (
    re.compile(rf"[\[({{<][ \t]*+(?:@|\.|{_A}|{_D})[ \t]*+[\])}}>]"),
    re.compile(rf"{_D}[ ,\t_-]"),
    re.compile(r"[0-9][ .()-]{0,2}[oil|][ .()-]{0,2}[0-9oil|]"),
    re.compile(rf"{_A}[ \t]++[a-z0-9-]++\.[a-z]"),
)
_MARKS = ("&#", "&commat;", "&period;", "&plus;", "%40", "%2e", " @", "@ ", "\t@", "@\t", " . ")


def suspect(text: str) -> bool:
    """Whether a transducer may have something to rewrite."""
    if not text.isascii() and any(alike(c) is not None for c in set(text)):
        return True
    lower = text.lower()
    if any(m in lower for m in _MARKS) or any(p.search(lower) for p in _SIGNS):
        return True
    return not _DIGIT_BYTES.isdisjoint(text.encode().translate(_PARTED).split()) and bool(_SPELLED.search(lower))


def unseen(of: Rewritten) -> None:
    """Look-alikes become what they look like; characters that can't be seen go."""
    odd = {c for c in set(of.text) if alike(c) is not None}
    if odd:  # nothing but characters beyond ASCII
        of.edit([(m.start(), m.end(), alike(m[0])) for m in re.finditer(f"[{re.escape(''.join(sorted(odd)))}]", of.text)])


def references(of: Rewritten) -> None:
    """Character references and percent codes for signs of addresses."""

    def sign(ref: str) -> str:
        ref = ref.lower()
        name = ref.strip("&;")
        return _REFERRED[name] if name in _REFERRED else chr(int(name[2:], 16) if name[1] == "x" else int(name[1:]))

    of.edit([(m.start(), m.end(), sign(m[0])) for m in _REFERENCE.finditer(of.text)])


def spelled_digits(of: Rewritten) -> None:
    """Runs of spelled digits become figures: those that a space or hyphen parts join, a comma leaves a space, and plus becomes its sign."""
    edits: list[tuple[int, int, str]] = []
    for run in _RUN.finditer(of.text):
        words = run[0]
        items = list(_ITEM.finditer(words))
        if sum(m[3] is not None for m in items) < 3:
            continue
        base = run.start()
        for k, m in enumerate(items):
            if m[1]:
                edits.append((base + m.start(), base + m.end(), "+"))
            elif m[3]:
                edits.append((base + m.start(), base + m.end(), str(_DIGITS[m[3].lower()]) * _TIMES.get((m[2] or "").lower(), 1)))
            if k + 1 < len(items) and not m[1]:
                gap = words[m.end() : items[k + 1].start()]
                if m[3] and items[k + 1][3] and gap in (" ", "-"):
                    edits.append((base + m.end(), base + items[k + 1].start(), ""))
                elif "," in gap and gap.strip(" ,") == "":
                    edits.append((base + m.end(), base + items[k + 1].start(), " "))
    of.edit(edits)


def at_and_dot(of: Rewritten) -> None:
    """Words, brackets and spaces for @ and dots. A bare word counts only between what makes a whole address."""
    of.edit([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(of.text)])
    of.edit([(m.start(), m.end(), ".") for m in _BETWEEN.finditer(of.text)])
    edits: list[tuple[int, int, str]] = []
    for m in _BARE.finditer(of.text):
        labels = re.split(rf"{_DOTS.pattern}|\.", m[3], flags=_FLAGS)
        # a bare word after the address may have been read as its label
        dots = list(re.finditer(rf"{_DOTS.pattern}|\.", m[3], _FLAGS))
        while len(labels) > 1 and labels[-1].lower() not in _LAST_LABELS:
            labels.pop()
        if len(labels) < 2:
            continue
        dots = dots[: len(labels) - 1]
        spelled = any(d[0] != "." for d in dots)
        by_sign = "@" in m[2]
        if not by_sign and (m[1].lower() in _PROSE or labels[0].lower() in _PROSE or not spelled and m[1].isalpha()):
            continue
        if m[2] != "@":
            edits.append((m.start(2), m.end(2), "@"))
        edits += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in dots if d[0] != "."]
    of.edit(edits)


def figures(of: Rewritten) -> None:
    """Letters in place of figures, in runs with at least twice as many figures."""
    edits = []
    for m in _FIGURES.finditer(of.text):
        letters = [k for k, c in enumerate(m[0]) if c in _FIGURE]
        if letters and 2 * len(letters) <= sum(map(str.isdigit, m[0])):
            edits += [(m.start() + k, m.start() + k + 1, _FIGURE[m[0][k]]) for k in letters]
    of.edit(edits)


TRANSDUCERS = (unseen, references, spelled_digits, at_and_dot, figures)


def identifiers(text: str) -> list[tuple[str, int, int, bool]]:
    """kind, begin, end (code points of the text) and whether it is disguised, by kind, then place."""
    plain = {kind: find(text) for kind, find in KINDS.items()}
    added: dict[str, set[Span]] = {}
    if suspect(text):
        of = Rewritten(text)
        for transducer in TRANSDUCERS:
            transducer(of)
        if of.changed:
            for kind, find in KINDS.items():
                begins = [b for b, _ in plain[kind]]
                spans = {s for s in (of.source(*span) for span in (parted_cards if kind == "card" else find)(of.text)) if s}
                added[kind] = {s for s in spans if not ((k := bisect_right(begins, s[0])) and s[1] <= plain[kind][k - 1][1])}
    return [(kind, *span, new) for kind in KINDS for span, new in sorted([*((s, False) for s in plain[kind]), *((s, True) for s in added.get(kind, ()))])]


def find_identifiers(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans, an array of (kind, start, end, disguised), for every row of docs, whole texts; in code points, end exclusive.

    A null or empty text has none. Repeated rows stay. Further columns are not read. Spelled numbers above nine, and names without
    an @ or a word for it, are not found.
    """
    kind = docs.schema[key].dataType.simpleString()
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [identifiers(t.as_py() or "") for t in batch.column("text")]
            spans = [[dict(zip(entry.names, s, strict=True)) for s in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, pa.list_(entry))], ["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {kind}, spans array<struct<kind: string, start: long, end: long, disguised: boolean>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def mask(docs: DataFrame, *, key: str = "doc_id", text: str = "text", out: str = "masked") -> DataFrame:
    """key and each text with its identifiers, plain and disguised, replaced by their kind in brackets; of overlapping ones the longest reach. Null texts stay null."""
    kind = docs.schema[key].dataType.simpleString()

    def masked(t: str | None) -> str | None:
        if t is None:
            return None
        parts, last = [], 0
        for what, begin, end, _ in sorted(identifiers(t), key=lambda s: (s[1], -s[2])):
            if begin >= last:
                parts += [t[last:begin], f"[{what}]"]
            last = max(last, end)
        return "".join(parts) + t[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([masked(t.as_py()) for t in batch.column("text")], pa.string())], ["key", "masked"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, masked string").withColumnsRenamed({"key": key, "masked": out})
