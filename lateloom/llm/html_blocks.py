"""Leaf blocks of an HTML page: runs of text that no block-level tag parts, with what their ancestors say about them."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Fixed values of HTML: elements without content, elements whose content is no text (RAW to the end of the page where it isn't closed), and elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noembed", "noframes", "iframe")
TEXT = ("textarea", "title", "xmp")  # whose content is text without tags
OPAQUE = frozenset("template svg object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br"
    " math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom merror mfenced menclose mmultiscripts mtable mtr mtd semantics annotation".split()
)
#: An element that a start tag of the key closes, if one is open above the elements in the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

#: Where something begins that is no text: a comment, a tag or its end, another declaration.
_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/><]*)|[!?/])")
#: From behind a tag's name up to the > that ends it; > in quotes doesn't.
_TO_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in (*OPAQUE, *RAW, *TEXT)}
_NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]{2,}")
_SPACE = re.compile(r"\s+")


class Context:
    """What the ancestors of a block say: the features of an element that none above it has, and the context of these.

    Elements side by side that say the same share one, so a page has as many features as it has attributes.
    """

    __slots__ = ("new", "parent")

    def __init__(self, parent: Context | None = None, new: tuple[str, ...] = ()) -> None:
        self.parent, self.new = parent, new

    def __iter__(self) -> Iterator[str]:
        at: Context | None = self
        while at:
            yield from at.new
            at = at.parent


@dataclass
class Block:
    text: str
    tag: str
    context: Context
    linked: int  # characters inside links


@dataclass
class _Frame:
    tag: str
    context: Context
    block: str  # the nearest element that isn't inline
    new: tuple[str, ...] = ()


@dataclass
class _Parser:
    stack: list[_Frame] = field(default_factory=lambda: [_Frame("", Context(), "")])
    where: defaultdict[str, list[int]] = field(default_factory=lambda: defaultdict(list))  # places of open elements, by name
    solid: list[int] = field(default_factory=lambda: [0])  # places of those that aren't inline
    said: set[str] = field(default_factory=set)  # features of open elements
    contexts: dict[tuple[Context, tuple[str, ...]], Context] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    frame: _Frame | None = None

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.blocks.append(Block(text, self.frame.block, self.frame.context, min(self.linked, len(text))))
            self.parts, self.linked, self.frame = [], 0, None

    def text(self, raw: str) -> None:
        if not raw:
            return
        if self.frame is None:
            if raw.isspace():
                return
            self.frame = self.stack[-1]
        self.parts.append(raw)
        if self.where["a"]:
            self.linked += len(raw.strip())

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            self.imply(tag)
        elif tag == "br":
            self.text(" ")
        elif tag == "a" and self.where["a"]:
            self.close("a")
        if tag in VOID or attributes.endswith("/") and (tag not in INLINE or tag == "math"):
            return
        top = self.stack[-1]
        named = (w for m in _NAMING.findall(attributes) for w in _WORDS.findall(m.lower())) if "=" in attributes else ()
        new = tuple(sorted({f"in:{tag}", *(f"name:{w}" for w in named)} - self.said))
        context = self.contexts.setdefault((top.context, new), Context(top.context, new)) if new else top.context
        self.said.update(new)
        self.where[tag].append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(_Frame(tag, context, top.block if tag in INLINE else tag, new))

    def imply(self, tag: str) -> None:
        """Closes what a start tag of this name ends."""
        closed, within = _CLOSES.get(tag, (set(), set()))
        if closed:
            low = max((self.where[t][-1] for t in within if self.where[t]), default=0)
            above = [self.where[t][k] for t in (*closed, "p") if (k := bisect_right(self.where[t], low)) < len(self.where[t])]
            if above:
                self.pop(min(above))
            return
        while (t := self.stack[self.solid[-1]].tag) == "p" or t in _HEADINGS and tag in _HEADINGS:
            self.pop(self.solid[-1])

    def pop(self, k: int) -> None:
        for f in self.stack[k:]:
            self.where[f.tag].pop()
            self.said.difference_update(f.new)
        while self.solid[-1] >= k:
            self.solid.pop()
        del self.stack[k:]

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.where[tag] and (tag not in INLINE or self.where[tag][-1] > self.solid[-1]):
            self.pop(self.where[tag][-1])


class _Ends:
    """Where tags of a page end. In one pass from the right, once a tag without an end is met, so that many of these take no longer."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def after(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at at; -1 without one."""
        if self.places is None:
            m = _TO_END.match(self.page, at)
            if m:
                return m.end() - 1
            self._prepare()
        k = bisect_left(self.places, at)
        return self.ends[k]

    def _prepare(self) -> None:
        self.places = [m.start() for m in re.finditer("[>\"']", self.page)]
        n = len(self.places)
        self.ends = [-1] * (n + 1)
        later = {'"': n, "'": n}  # the next quote of each kind
        for k in range(n - 1, -1, -1):
            c = self.page[self.places[k]]
            if c == ">":
                self.ends[k] = self.places[k]
            else:
                if later[c] < n:
                    self.ends[k] = self.ends[later[c] + 1]
                later[c] = k


def _past(page: str, tag: str, at: int) -> tuple[int, int] | None:
    """The next end tag of this name: its begin, and the place behind it."""
    m = _ENDS[tag].search(page, at)
    end = page.find(">", m.end()) if m else -1
    return (m.start(), end + 1) if end >= 0 else None


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Character references are decoded and white space inside a block is one space.

    Takes time in proportion to the page, whatever is left open: a < that begins nothing, or a tag that doesn't end, is text; an
    end tag, declaration or comment without an end, and script and the like without an end tag, go up to the end of the page.
    """
    p, ends = _Parser(), _Ends(page)
    at = look = 0
    unclosed: set[str] = set()
    while m := _START.search(page, look):
        name, closing = (m[3] or "").lower(), bool(m[2])
        end = ends.after(m.end()) if name else -1
        if name and not closing and end < 0:
            look = m.start() + 1
            continue
        p.text(page[at : m.start()])
        if name and end >= 0:
            at = end + 1
            attributes = page[m.end() : end]
            whole = page[m.end()] != "<"  # the name, that is
            if closing:
                p.close(name)
            elif whole and name in RAW:
                p.flush()
                at = (_past(page, name, at) or (0, len(page)))[1]
            elif whole and name in TEXT:
                p.flush()
                begin, behind = _past(page, name, at) or (len(page), len(page))
                p.open(name, attributes)
                content = page[at:begin]
                p.text(content if name != "xmp" else content.replace("&", "&amp;"))  # has no character references
                p.close(name)
                at = behind
            elif name in OPAQUE and not attributes.endswith("/") and name not in unclosed and (found := _past(page, name, at)):
                p.flush()
                at = found[1]
            else:
                if name in OPAQUE and not attributes.endswith("/"):
                    unclosed.add(name)
                p.open(name, attributes.strip())
        elif m[1]:
            at = page.find("-->", m.end())
            at = len(page) if at < 0 else at + 3
        else:
            at = page.find(">", m.end())
            at = len(page) if at < 0 else at + 1
        look = at
    p.text(page[at:])
    p.flush()
    return p.blocks
