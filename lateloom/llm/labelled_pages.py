"""Labelled pages to learn from: random layouts of articles among menus, notices, adverts, forms, comments and the like.

The words are made up, so that a model learns from markup and shape and not from a language.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

_SYLLABLES = "an be co der el fi gar hu in jo ka lo mi ner os pra qui re sta tion um ver wha xi yo zen é ü ñ ch".split()


@dataclass
class _Page:
    rng: random.Random
    html: list[str] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    mentioned: str = ""

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        mark = self.rng.choice(["", "", "", "", "%%% ", "!! ", " | "])
        return (f"{mark} ".join(self.word() for _ in range(self.rng.randint(low, high)))).capitalize() + self.rng.choice([".", ".", ".", "!", "?"])

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize()

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 2, 3, 5, 8])))

    def add(self, tag: str, text: str, label: int, inside: str = "") -> None:
        if self.rng.random() < 0.12:
            text = text.replace(" ", f" <{(t := self.rng.choice(['b', 'i', 'em', 'span']))}>", 1) + f"</{t}>"
        self.html.append(f"<{tag}{inside}>{text}" + ("" if tag in ("p", "li") and self.rng.random() < 0.1 else f"</{tag}>"))
        self.labels.append(label)

    def wrap(self, tag: str, names: list[str]) -> str:
        """Opens an element, mostly with one of names as class or id; what closes it is returned."""
        name = self.rng.choice([*names, ""]) if names else ""
        extra = self.rng.choice(["", "-box", "-wrap", "_main", " clearfix"]) if self.rng.random() < 0.3 else ""
        self.html.append(f'<{tag} {self.rng.choice(["class", "class", "id"])}="{name}{extra}">' if name else f"<{tag}>")
        return f"</{tag}>"

    def links(self, n: int, item: str = "li") -> None:
        outer = {"li": self.rng.choice(["ul", "ul", "ol"])}.get(item)
        if outer:
            self.html.append(f"<{outer}>")
        for _ in range(n):
            self.add(item, f'<a href="/{self.word()}">{self.words(1, 4)}</a>', 0)
        if outer:
            self.html.append(f"</{outer}>")


def _menu(p: _Page) -> None:
    end = p.wrap(*p.rng.choice([("nav", []), ("nav", ["main-nav", "menu"]), ("div", ["menu", "nav", "navbar", "navigation", "topnav", "breadcrumbs", "toolbar"])]))
    if p.rng.random() < 0.2:  # in one line
        p.add(p.rng.choice(["div", "p", "td"]), p.rng.choice(["", " | ", "<br>"]).join(f'<a href="/{p.word()}">{p.words(1, 3)}</a> ' for _ in range(p.rng.randint(2, 7))), 0)
    else:
        p.links(p.rng.randint(2, 9), p.rng.choice(["li", "li", "div"]))
    p.html.append(end)


def _header(p: _Page) -> None:
    end = p.wrap(*p.rng.choice([("header", []), ("header", ["site-header"]), ("div", ["header", "masthead", "banner", "topbar"])]))
    p.add(p.rng.choice(["div", "p", "h2"]), p.words(1, 6), 0)
    if p.rng.random() < 0.5:
        _menu(p)
    p.html.append(end)


def _aside(p: _Page) -> None:
    end = p.wrap(*p.rng.choice([("aside", []), ("aside", ["sidebar"]), ("div", ["sidebar", "related", "widget", "recommended", "trending", "most-read", "rail"]), ("section", ["related", "sidebar", "widget"])]))
    if p.rng.random() < 0.7:
        p.add(p.rng.choice(["h2", "h3", "h4", "div"]), p.words(1, 4), 0)
    if p.rng.random() < 0.7:
        p.links(p.rng.randint(1, 8))
    for _ in range(p.rng.choice([0, 0, 1, 2])):
        p.add("p", p.prose(), 0)
    p.html.append(end)


def _notice(p: _Page) -> None:
    end = p.wrap(*p.rng.choice([("div", ["notice", "cookie-notice", "cookie-banner", "alert", "consent", "gdpr", "popup", "modal", "message", "paywall", "warning", "disclaimer"]), ("section", ["notice", "alert", "cookie"])]))
    p.add(p.rng.choice(["p", "div", "p"]), p.prose() if p.rng.random() < 0.7 else p.words(2, 8), 0)
    if p.rng.random() < 0.4:
        p.add("button", p.words(1, 2), 0)
    p.html.append(end)


def _advert(p: _Page) -> None:
    name = p.rng.choice(["ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad", "sponsor", "ad-slot"])
    if p.rng.random() < 0.6:
        p.add("div", " ".join(p.sentence(2, 9) for _ in range(p.rng.randint(1, 3))), 0, f' class="{name}"')
    else:
        end = p.wrap(p.rng.choice(["div", "aside", "section"]), [name])
        p.add(p.rng.choice(["p", "div", "h3"]), p.sentence(), 0)
        p.html.append(end)


def _form(p: _Page) -> None:
    end = p.wrap("form", ["search", "newsletter", "subscribe", "login", "signup", "contact"])
    for _ in range(p.rng.randint(1, 3)):
        p.add(p.rng.choice(["p", "div", "legend", "button", "option"]), p.words(1, 6) if p.rng.random() < 0.7 else p.sentence(), 0)
        p.html.append('<input name="q">')
    p.html.append(end)


def _comments(p: _Page) -> None:
    end = p.wrap(p.rng.choice(["section", "div", "ol", "div"]), ["comments", "comment-list", "comments-area", "discussion", "responses", "replies", "reader-comments", "disqus-thread"])
    if p.html[-1] == end.replace("/", ""):
        p.html[-1] = p.html[-1][:-1] + ' class="comments">'
    for _ in range(p.rng.randint(1, 5)):
        inner = p.wrap(*p.rng.choice([("article", ["comment"]), ("div", ["comment", "comment-body", "reply"]), ("li", ["comment"])]))
        if p.rng.random() < 0.5:
            p.add(p.rng.choice(["div", "h4", "p"]), p.words(1, 3), 0, p.rng.choice(["", ' class="comment-author"', ' class="author"']))
        p.add(p.rng.choice(["p", "p", "div"]), p.prose(), 0)
        p.html.append(inner)
    p.html.append(end)


def _footer(p: _Page) -> None:
    end = p.wrap(*p.rng.choice([("footer", []), ("footer", ["site-footer"]), ("div", ["footer", "copyright", "colophon", "site-info", "bottom"])]))
    for _ in range(p.rng.randint(1, 3)):
        if p.rng.random() < 0.6:
            mark = p.rng.choice(["&copy; ", "©", ""])
            text = f"{mark}{p.word()}.example.org &middot; {p.sentence()}"
            if p.rng.random() < 0.5:
                p.add("p", text, 0)
            elif p.html[-1].startswith(("<footer", "<div")):
                p.html.append(text)
                p.labels.append(0)
                break
        else:
            p.links(p.rng.randint(1, 5), p.rng.choice(["li", "p"]))
    p.html.append(end)


def _share(p: _Page) -> None:
    end = p.wrap("div", ["share", "social", "sharing", "tags", "share-buttons", "follow"])
    p.links(p.rng.randint(1, 4))
    p.html.append(end)


def _article(p: _Page) -> None:
    ends = []
    shape = p.rng.random()
    if shape < 0.5:
        ends.append(p.wrap("article", p.rng.choice([[], ["post", "story", "entry", "article"]])))
    elif shape < 0.65:
        ends.append(p.wrap("main", []))
        if p.rng.random() < 0.5:
            ends.append(p.wrap("article", []))
    else:
        ends.append(p.wrap(p.rng.choice(["div", "div", "section"]), p.rng.choice([["content", "post", "entry-content", "article-body", "story", "main", "post-body", "postbody", "message", "text", "article"], []])))
    if p.rng.random() < 0.12:
        p.add(p.rng.choice(["h3", "div", "h2"]), p.words(2, 9), 1)
    elif p.rng.random() < 0.85:
        if p.rng.random() < 0.15:
            p.html.append("<header>")
            p.add("h1", p.words(2, 12), 1)
            p.html.append("</header>")
        else:
            p.add("h1", p.words(1, 12), 1)
    if p.rng.random() < 0.15:
        ends.append(p.wrap("div", ["body", "article-body", "entry-content", "text", "content"]))
    plain = "div" if p.rng.random() < 0.05 else "p"
    for _ in range(p.rng.choice([1, 2, 4, 8, 14])):
        kind = p.rng.random()
        if kind < 0.72:
            p.add(plain, p.prose() if p.rng.random() < 0.85 else p.words(1, 4) + ".", 1)
        elif kind < 0.80:
            p.add(p.rng.choice(["h2", "h3"]), p.words(1, 8), 1)
        elif kind < 0.85:
            p.html.append("<ul>")
            for _ in range(p.rng.randint(1, 4)):
                p.add("li", p.sentence() if p.rng.random() < 0.7 else p.words(1, 4), 1)
            p.html.append("</ul>")
        elif kind < 0.89:
            p.html.append("<blockquote>")
            p.add("p", p.prose(), 1)
            p.html.append("</blockquote>")
        elif kind < 0.92:
            p.add("pre", p.sentence(), 1)
        elif kind < 0.94:
            p.html.append('<figure><img src="x.png">')
            p.add("figcaption", p.sentence(), 1)
            p.html.append("</figure>")
        elif kind < 0.96:
            p.html.append("<table><tr>")
            for _ in range(p.rng.randint(1, 4)):
                p.add("td", p.words(1, 4), 1)
            p.html.append("</tr></table>")
        elif kind < 0.98:
            p.add("p", f'{p.sentence()} <a href="/x">{p.words(1, 4)}</a> {p.sentence()}', 1)
        else:
            p.rng.choice([_advert, _aside, _notice, _share, _form])(p)
    if p.rng.random() < 0.12:
        p.rng.choice([_comments, _share, _advert, _form])(p)
    p.html += ends[::-1]


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page, and for each of its leaf blocks whether it is main text."""
    p = _Page(random.Random(seed))
    p.html.append(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{p.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    p.labels.append(0)
    before = [f for f, share in ((_notice, 0.15), (_header, 0.35), (_menu, 0.6), (_form, 0.1), (_advert, 0.4), (_aside, 0.15)) if p.rng.random() < share]
    p.rng.shuffle(before)
    after = [f for f, share in ((_share, 0.15), (_comments, 0.3), (_aside, 0.25), (_form, 0.12), (_advert, 0.15), (_notice, 0.1)) if p.rng.random() < share]
    p.rng.shuffle(after)
    if p.rng.random() < 0.8:
        after.append(_footer)
    ends = [p.wrap(p.rng.choice(["div", "main", "div"]), ["page", "wrapper", "container", "site"])] if p.rng.random() < 0.25 else []
    cell = ("<td>", "</td>") if p.rng.random() < 0.1 else ("", "")  # a table for a layout
    p.html.append("<table><tr>" if cell[0] else "")
    for f in (*before, _article, *after):
        p.html.append(cell[0])
        f(p)
        p.html.append(cell[1])
    p.html.append("</tr></table>" if cell[0] else "")
    p.html += [*ends, "</body></html>" if p.rng.random() < 0.9 else ""]
    page = p.rng.choice(["", "", "\n"]).join(p.html)
    return (_unnamed(p.rng, page) if p.rng.random() < UNNAMED else page), p.labels


#: Share of pages whose classes and ids say nothing, as where they are generated; of half of these no element says what it is for either.
UNNAMED = 0.35


def _unnamed(rng: random.Random, page: str) -> str:
    made: dict[str, str] = {}
    stem = rng.choice(["css-", "sc-", "_", "x", "jss"])
    name = lambda m: f'{m[1]}="{made.setdefault(m[2], stem + format(rng.getrandbits(24), "x"))}"'
    page = re.sub(r'\b(class|id)="([^"]*)"', name, page)
    return re.sub(r"(</?)(?:article|main|nav|header|footer|aside|section)\b", r"\1div", page) if rng.random() < 0.5 else page
