"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

Each block of text has features of its ancestors (tags, and words of their classes and ids) and of its own text (length, share of
links, ends of sentences, place in the page). The field has two labels, main text and other, and is trained by
gradient ascent on the likelihood of labelled pages; a page's labels are those of greatest joint probability, by Viterbi's
algorithm. Pages are independent: they are read once, and nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release
from .html_blocks import Block, Context, leaf_blocks
from .labelled_pages import labelled_page

#: Labelled pages to train on, steps of ascent, and the least pages a feature must be in.
PAGES, STEPS, LEAST = 600, 110, 3


def _kind(block: Block) -> str:
    """Links, a few words, a line, or prose."""
    n = block.text.count(" ") + 1
    return "links" if block.linked > 0.8 * len(block.text) else "few" if n < 5 else "line" if n < 12 else "prose"


def block_features(blocks: list[Block]) -> list[tuple[Context, tuple[str, ...]]]:
    """For each block the features of its ancestors, and those of its text and neighbours."""
    out = []
    last = len(blocks) - 1
    kinds = ["none", *map(_kind, blocks), "none"]
    for i, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        own = (
            f"tag:{b.tag}",
            f"words:{n.bit_length()}",
            "links:all" if share > 0.8 else "links:some" if share > 0.2 else "links:few",
            "stop" if b.text[-1] in ".!?…\"'”’)" else "no stop",
            "copyright" if "©" in b.text else "",
            f"kinds:{kinds[i]} {kinds[i + 1]} {kinds[i + 2]}",
            f"kind in {b.tag}:{kinds[i + 1]}",
            "first" if i == 0 else "",
            "last" if i == last else "",
            f"turn:{b.tag}" if i == 0 or blocks[i - 1].context is not b.context else "same",
            "after heading" if i and blocks[i - 1].tag in ("h1", "h2", "h3") else "",
        )
        out.append((b.context, own))
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features for the label main text, and of transitions (from, to)."""

    weights: dict[str, float]
    moves: tuple[tuple[float, float], tuple[float, float]]
    bias: float

    def labels(self, scores: list[float]) -> list[int]:
        """Viterbi's algorithm for two labels. Of two equal ways, the one that leaves text out."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.moves
        other, main = 0.0, scores[0]
        back = []
        for s in scores[1:]:
            from_main0, from_main1 = main + m10 > other + m00, main + m11 > other + m01
            other, main = max(other + m00, main + m10), max(other + m01, main + m11) + s
            back.append((from_main0, from_main1))
        label = int(main > other)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]

    def of_context(self, context: Context, known: dict[Context, float]) -> float:
        """The score of ancestors' features: that of the ones above, and what an element adds. known: contexts of the page that have theirs."""
        chain: list[Context] = []
        at: Context | None = context
        while at is not None and at not in known:
            chain.append(at)
            at = at.parent
        score = self.bias if at is None else known[at]
        for c in reversed(chain):
            known[c] = score = score + sum(self.weights.get(f, 0.0) for f in c.new)
        return score

    def extract(self, page: str) -> str:
        blocks = leaf_blocks(page)
        known: dict[Context, float] = {}
        scores = [self.of_context(context, known) + sum(self.weights.get(f, 0.0) for f in own) for context, own in block_features(blocks)]
        return " ".join(b.text for b, label in zip(blocks, self.labels(scores), strict=True) if label)


def train(pages: Iterable[tuple[list[Block], list[int]]], steps: int = STEPS, least: int = LEAST) -> Field:
    """Fits a field to pages' blocks and labels: regularised maximum likelihood, by full gradients with adaptive steps."""
    rows = [([{*c, *o} - {""} for c, o in block_features(blocks)], labels) for blocks, labels in pages if blocks]
    seen = Counter(f for own, _ in rows for f in set().union(*own))
    names = sorted(f for f, n in seen.items() if n >= least)
    index = {f: i for i, f in enumerate(names)}
    longest, n = max(len(own) for own, _ in rows), len(rows)
    x = np.zeros((n, longest, len(names) + 1), np.float32)
    y = np.zeros((n, longest), np.int64)
    inside = np.zeros((n, longest), bool)
    x[:, :, -1] = 1
    for r, (own, labels) in enumerate(rows):
        inside[r, : len(own)] = True
        y[r, : len(own)] = labels
        for t, features in enumerate(own):
            x[r, t, [index[f] for f in features if f in index]] = 1
    flat = x.reshape(-1, x.shape[2])[inside.ravel()]
    w, moves = np.zeros(flat.shape[1]), np.zeros((2, 2))
    both = np.zeros((2, 2))
    pairs = inside[:, 1:]
    np.add.at(both, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    size, first, second = w.size + 4, np.zeros(w.size + 4), np.zeros(w.size + 4)
    for step in range(1, steps + 1):
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1][inside] = flat @ w.astype(np.float32)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + emit[:, t]
        behind = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            to = (emit[:, t + 1] + behind[:, t + 1])[:, None, :] + moves
            behind[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(to[:, :, 0], to[:, :, 1]), 0)
        joint = ahead + behind
        total = np.logaddexp(joint[:, 0, 0], joint[:, 0, 1])
        main = np.exp(joint[:, :, 1] - total[:, None])
        expected = np.zeros((2, 2))
        for t in range(1, longest):
            p = np.exp(ahead[:, t - 1, :, None] + moves + (emit[:, t] + behind[:, t])[:, None, :] - total[:, None, None])
            expected += p[inside[:, t]].sum(0)
        gradient = np.concatenate([(flat.T @ (y - main)[inside].astype(np.float32)) - 0.3 * w, (both - expected - 0.3 * moves).ravel()])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        change = 0.15 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w += change[: size - 4]
        moves = moves + change[size - 4 :].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in index.items()}, tuple(map(tuple, moves.tolist())), float(w[-1]))


@lru_cache(maxsize=1)
def default_field() -> Field:
    made = ((leaf_blocks(page), labels) for page, labels in map(labelled_page, range(PAGES)))
    return train((blocks, labels) for blocks, labels in made if len(blocks) == len(labels))


def extract_text(pages: DataFrame, field: Field | None = None, *, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns keep, text and n_chars (code points) for every row of pages.

    A null or empty page, and one without main text, has empty text. Repeated rows stay. Further columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    own = pages.select(F.col(key).alias("c0"), *(F.col(c).alias(f"c{i + 1}") for i, c in enumerate(keep)), F.col(html).cast("string").alias("html"))
    fields = [f for f in own.schema if f.name != "html"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in batches:
            texts = [model.extract(p.as_py() or "") for p in batch.column("html")]
            columns = [*(batch.column(f.name) for f in fields), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "text", "n_chars"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    names = {f"c{i}": c for i, c in enumerate((key, *keep))}
    return own.mapInArrow(extract, f"{schema}, text string, n_chars long").withColumnsRenamed(names)
