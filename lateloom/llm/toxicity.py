"""Toxicity by maximum-scoring segment search.

A token's score is its log-odds of standing in a toxic document. The odds are estimated from labelled documents under
Dirichlet priors that form a chain: a word's prior is centred on the odds of its longest known proper beginning, that one's
on the next shorter, down to the odds of any token; so unseen inflections of a toxic stem still score. A constant drift makes
ordinary text lose score, and one linear scan of a text finds all its maximal scoring segments. By extreme-value
statistics, a segment of score S in a text of m tokens is as rare as K m exp(-lambda S): lambda is the positive root of
mean(exp(lambda s)) = 1 over the scores s of clean texts' tokens, and K is what makes the number of their highest segments as
expected. What a text's segments are rarer than chance adds up to its evidence, and a logistic curve, fitted on the labelled
documents, turns that into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import held, materialize, release

#: Labelled rows that the model is fitted on, at most: those of least hash. Everything else covers all rows.
FIT_ROWS = 20_000
#: Weight of a prior in documents; least documents of a class that a feature needs; drift of a token, in log-odds.
PRIOR, LEAST, DRIFT = 1.0, 3, 0.35
#: Weight, in documents of each class, of the symmetric part of the prior; least log-odds of a feature in standard errors.
EVEN, LEAST_Z = 0.3, 3.0
#: Share of clean texts' segments below those that K is fitted on; weight of a toxic document, against a clean one, in the curve's fit.
TAIL, TOXIC_WEIGHT = 0.97, 4.0
#: Lengths of the beginnings that are features. A beginning is proper: the word is longer.
BEGINNINGS = range(4, 10)
#: Entries of a worker's cache of words, which then starts anew.
CACHE_ENTRIES = 100_000

_WORD = re.compile(r"\w+")


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence whose items score -drift but at the given places: first, last, score.

    The linear-time stack algorithm for disjoint maximal segments: each new positive item begins a segment that merges
    with earlier ones as long as that makes it greater.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, total before it, total after it
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total -= drift * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, low, high = place, before, total
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            first, _, low, _ = stack[j]
            del stack[j:]
        stack.append((first, place, low, high))
    return [(a, b, high - low) for a, b, low, high in stack]


@dataclass(frozen=True)
class Model:
    """Scores of features (a word, or a beginning followed by *), the drift, and what extreme-value statistics and the final curve need."""

    scores: dict[str, float]
    scale: float  # lambda
    log_k: float
    slope: float
    intercept: float
    base: float  # a text without evidence, by length: nothing else is known of it

    def word_score(self, word: str) -> float:
        found = self.scores.get(word)
        if found is None:
            for n in range(min(len(word) - 1, BEGINNINGS[-1]), BEGINNINGS[0] - 1, -1):
                found = self.scores.get(word[:n] + "*")
                if found is not None:
                    break
            else:
                return -DRIFT
        return found - DRIFT

    def evidence(self, n_tokens: int, found: list[tuple[int, int, float]]) -> float:
        """How much rarer than chance the significant segments are, in nats, all together."""
        rarity = (self.scale * s - self.log_k - math.log(max(n_tokens, 1)) for _, _, s in found)
        return sum(x for x in rarity if x > 0)

    def probability(self, evidence: float) -> float:
        x = self.slope * math.log1p(evidence) + self.intercept if evidence > 0 else self.base
        return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


class Scorer(dict):
    """Scores of words, kept while a worker lives."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        s = self.model.word_score(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = s
        return s

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and the maximal segments by token."""
        found = list(map(self.__getitem__, _WORD.findall(text.lower())))
        places = [i for i, s in enumerate(found) if s != -DRIFT]
        return len(found), segments(places, [found[i] for i in places], DRIFT) if places else []


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        names: list[str] = []
        toxic: list[int] = []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = set(_WORD.findall((text or "").lower()))
            own |= {w[:n] + "*" for w in own for n in BEGINNINGS if n < len(w)}
            names += own
            toxic += [label] * len(own)
        label = pa.array(toxic, pa.int64())
        for at in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100_000], pa.string()), label[at : at + 100_000]], ["feature", "toxic"])


def _log_odds(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Class-balanced log-odds of each feature, each shrunk towards its parent's."""
    share: dict[str, float] = {}

    def parent(feature: str) -> float:
        stem = feature.rstrip("*")
        top = len(stem) - 1
        for n in range(min(top, BEGINNINGS[-1]), BEGINNINGS[0] - 1, -1):
            if (got := share.get(stem[:n] + "*")) is not None:
                return got
        return 0.5

    balance = n_toxic / n_clean
    for feature in sorted(counts, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"))):
        t, n = counts[feature]
        c = (n - t) * balance
        q = (t + PRIOR * parent(feature) + EVEN) / (t + c + PRIOR + 2 * EVEN)
        if math.log(q / (1 - q)) >= LEAST_Z * math.sqrt(1 / (t + EVEN) + balance / (c + EVEN)):
            share[feature] = q
    return {f: math.log(q / (1 - q)) for f, q in share.items()}


def _scale(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of mean(exp(x * scores)) = 1, for scores (so often each) that are negative on average."""
    low, high = 1e-4, 20.0
    share = counts / counts.sum()
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(np.minimum(mid * scores, 700.0)) < 1 else (low, mid)
    return low


def _log_k(found: np.ndarray, n_tokens: float, scale: float) -> float:
    """log K, so that as many segments are as high as the highest of found (clean texts' segments) as expected."""
    if not len(found):
        return -math.log(n_tokens)
    least = float(np.quantile(found, TAIL))
    return math.log((found >= least).sum() / n_tokens) + scale * least


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labelled rows that aren't held out, at most fit_rows of them. Without both classes, no text has evidence.

    Of labels with the same key the greatest counts, of documents with the same key the least text; null keys and labels are left out.
    """
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("long").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("key").isNotNull())
    sample = rows.where(~held_out("key")).groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(fit_rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    one = texts.join(F.broadcast(sample), "key").groupBy("key").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # fit_rows ids are broadcast
    sample = materialize(one.select("text", "toxic"))
    n_toxic, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    none = Model({}, 1.0, 0.0, 1.0, 0.0, -4.0)
    if not n_toxic or n_toxic == n_all:
        return none
    n_clean = n_all - n_toxic
    counts = sample.mapInArrow(_features, "feature string, toxic long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    rates = (F.col("t") / n_toxic) / ((F.col("n") - F.col("t") + 0.5) / n_clean)
    kept = counts.where((F.col("t") >= LEAST) & (rates >= 3)).collect()
    scores = _log_odds({r["feature"]: (r["t"], r["n"]) for r in kept}, n_toxic, n_clean)
    draft = Model(scores, 1.0, 0.0, 1.0, 0.0, -4.0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text its tokens and segments, and with the first of a batch how often clean tokens have which score."""
        release()
        scorer = Scorer(draft)
        for batch in batches:
            texts, toxic = batch.column(0).fill_null("").to_pylist(), batch.column(1).to_pylist()
            out = [scorer.scan(t) for t in texts]
            seen: Counter[float] = Counter()
            for t, y in zip(texts, toxic, strict=True):
                if not y:
                    seen.update(map(scorer.__getitem__, _WORD.findall(t.lower())))
            levels = [list(seen.items()), *[[]] * (len(out) - 1)][: len(out)]
            columns = [[n for n, _ in out], [[s for _, _, s in x] for _, x in out], [[s for s, _ in x] for x in levels], [[n for _, n in x] for x in levels]]
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["toxic", "n", "scores", "levels", "times"])

    seen = sample.mapInArrow(scan, "toxic long, n long, scores array<double>, levels array<double>, times array<long>").toPandas()  # fit_rows rows
    clean = seen[seen["toxic"] == 0]
    levels, times = (np.concatenate([np.zeros(0), *seen[c]]) for c in ("levels", "times"))
    scale = _scale(levels, times) if len(levels) else 1.0
    log_k = _log_k(np.concatenate([np.zeros(0), *clean["scores"]]), max(float(clean["n"].sum()), 1.0), scale)
    model = Model(scores, scale, log_k, 1.0, 0.0, -4.0)
    x = np.array([model.evidence(n, [(0, 0, s) for s in own]) for n, own in zip(seen["n"], seen["scores"], strict=True)])
    y = seen["toxic"].to_numpy(float)
    some = x > 0
    base = math.log((y[~some].sum() + 0.5) / ((1 - y[~some]).sum() + 0.5))
    slope, intercept = _logistic(np.log1p(x[some]), y[some])
    return Model(scores, scale, log_k, slope, intercept, base)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Slope (not negative) and intercept that make y likeliest, toxic ones weighted, by Newton's method with step halving and a weak prior."""
    if not len(x):
        return 0.0, -1.0
    unit = max(float(x.mean()), 1e-9)
    a = np.stack([x / unit, np.ones_like(x)], 1)
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    w = np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        gradient = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), gradient)
        part = 1.0
        while part > 1e-6 and loss(w - part * step) > now:
            part /= 2
        w = w - part * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return max(float(w[0]) / unit, 0.0), float(w[1])


def score_documents(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, score, n_tokens and passages (begin and end by character, and score, of every significant segment) of every row, and the columns in keep.

    Empty and null texts have no evidence, and its score. Repeated rows stay. The model is broadcast: it has at most one entry
    for each feature of fit_rows texts that LEAST toxic ones share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = held("toxicity", m, lambda: Scorer(m))
        for batch in batches:
            scores, sizes, passages = [], [], []
            for t in batch.column("__text"):
                s = t.as_py() or ""
                n, found = scorer.scan(s)
                scores.append(m.probability(m.evidence(n, found)))
                sizes.append(n)
                passages.append(_passages(m, s, n, found) if found else [])
            extra = [pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(passages, _PASSAGES)]
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *extra], [*names, "score", "n_tokens", "passages"])

    own = docs.select(F.col(key), *(F.col(c) for c in keep if c != key), F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "__text")
    return own.mapInArrow(score, f"{schema}, score double, n_tokens long, passages array<struct<begin:long,end:long,score:double>>")


_PASSAGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _passages(model: Model, text: str, n: int, found: list[tuple[int, int, float]]) -> list[dict[str, float]]:
    kept = [x for x in found if model.evidence(n, [x]) > 0]
    if not kept:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case has more characters
        return [{"begin": 0, "end": len(text), "score": max(s for _, _, s in kept)}]
    places = [(m.start(), m.end()) for m in _WORD.finditer(low)]
    return [{"begin": places[a][0], "end": places[b][1], "score": s} for a, b, s in kept]
