"""k-means whose result doesn't hang on how rows are dealt out.

One algorithm at every size. Sums of coordinates and of distances are whole numbers (coordinates in fixed point, in two limbs), so
blocks can be added up in any order. Starts are drawn by content: in each round every different row draws an exponential key,
weighted by its squared distance from the candidates so far, and the 2 k least join them; then k-means++ chooses among the candidates,
weighted by the rows nearest to each. Empty centroids move to the farthest different rows, FAR of them a round.

A group of at most TASK_ROWS rows is fitted in one task. Of a larger one, packed blocks are stored once and only read from then on:
a pass returns partial sums and a few rows from each task, and centroids are the only thing that is written again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateloom.functions.arrays import lists, matrix
from lateloom.functions.sampling import content, exponential
from lateloom.functions.shared import materialize
from lateloom.params import AllZero, EmptyVectorSet, KmeansBudgetTooSmall

#: Rows of the largest group that is fitted in one task, and of a block of a larger one; a block has 2**16 at most, or its sums may not fit.
TASK_ROWS, BLOCK_ROWS = 1 << 16, 8192
#: Rows that a task holds while it packs blocks; numbers that it holds while it adds up.
PACK_ROWS, HELD = 1 << 16, 1 << 22
#: Rounds of candidates, and rows that empty centroids may move to in a round.
ROUNDS, FAR = 3, 8
#: Bits of a coordinate in fixed point, and of its lower limb: 2**40 rows can be added up.
BITS, LIMB = 46, 23


@dataclass
class Fit:
    centroids: np.ndarray
    assignments: np.ndarray
    wcss: float
    iterations: int


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equal ones, and its squared distance: always the sum of squared differences.

    A matrix product finds the centroids that can be the nearest ones, with a margin for its rounding; only these are compared.
    """
    out, dist = np.empty(len(x), np.int64), np.empty(len(x))
    squares = (centroids**2).sum(1)
    step = max(1, (1 << 22) // max(len(centroids), 1))
    for a in range(0, len(x), step):
        own = x[a : a + step]
        d = squares - 2 * own @ centroids.T
        margin = 1e-12 * x.shape[1] * ((own**2).sum(1) + squares.max())
        row, at = np.nonzero(d <= (d.min(1) + margin)[:, None])
        exact = ((own[row] - centroids[at]) ** 2).sum(1)
        begin = np.searchsorted(row, np.arange(len(own)))
        least = np.minimum.reduceat(exact, begin)
        first = np.flatnonzero(exact == least[row])
        first = first[np.searchsorted(row[first], np.arange(len(own)))]
        out[a : a + step], dist[a : a + step] = at[first], least
    return out, dist


def seed_centroids(x: np.ndarray, k: int, rng: np.random.Generator, strict: bool, weights: np.ndarray) -> np.ndarray:
    """k-means++, of rows that count weights times each. Where fewer than k rows differ, the last choice is repeated, or (strict) it is an error."""
    chosen = [int(rng.choice(len(x), p=weights / weights.sum()))]
    dist = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = (dist * weights).cumsum()
        if total[-1] <= 0:
            if strict:
                raise AllZero("fewer vectors differ than there are centroids")
            chosen += [chosen[-1]] * (k - len(chosen))
            break
        chosen.append(min(int(np.searchsorted(total, rng.random() * total[-1], "right")), len(x) - 1))
        dist = np.minimum(dist, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].copy()


def exponent(largest: float) -> int:
    """The power of two by which numbers up to largest become whole ones of at most BITS bits."""
    return BITS - math.frexp(largest)[1] if largest > 0 else 0


def _whole(x: np.ndarray, power: int) -> np.ndarray:
    return np.rint(np.ldexp(x, power)).astype(np.int64)


def _carried(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form of a sum that its limbs have."""
    return hi + (lo >> LIMB), lo & ((1 << LIMB) - 1)


def _real(hi: np.ndarray, lo: np.ndarray, power: int) -> np.ndarray:
    hi, lo = _carried(hi, lo)
    return np.ldexp(hi.astype(np.float64) * (1 << LIMB) + lo, -power)


@dataclass
class Sums:
    """What a pass adds up for one set of centroids: rows and coordinates of each, and squared distances of all."""

    n: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    spread: np.ndarray  # hi, lo

    @classmethod
    def none(cls, k: int, dim: int) -> Sums:
        return cls(np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64), np.zeros(2, np.int64))

    def add(self, x: np.ndarray, own: np.ndarray, dist: np.ndarray, largest: float) -> None:
        """At most 2**16 rows at once."""
        if not len(x):
            return
        order = np.argsort(own, kind="stable")
        place, first = np.unique(own[order], return_index=True)
        total = np.add.reduceat(_whole(x, exponent(largest))[order], first, axis=0)
        self.n[place] += np.diff(np.append(first, len(own)))
        self.hi[place] += total >> LIMB
        self.lo[place] += total & ((1 << LIMB) - 1)
        spread = int(_whole(dist, _spread_power(largest, x.shape[1])).sum())
        self.spread += (spread >> LIMB, spread & ((1 << LIMB) - 1))

    def wcss(self, largest: float, dim: int) -> float:
        return float(_real(self.spread[:1], self.spread[1:], _spread_power(largest, dim))[0])

    def moved(self, centroids: np.ndarray, far: np.ndarray, largest: float) -> np.ndarray:
        """The means; empty centroids go to the rows far, as far as there are any, and else stay."""
        out, filled = centroids.copy(), self.n > 0
        out[filled] = _real(self.hi[filled], self.lo[filled], exponent(largest)) / self.n[filled, None]
        empty = np.flatnonzero(~filled)[: len(far)]
        out[empty] = far[: len(empty)]
        return out


def _spread_power(largest: float, dim: int) -> int:
    return exponent(4 * dim * largest**2)


def _least(key: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with a finite key the most different ones of least key; equal rows have equal keys."""
    at = np.flatnonzero(np.isfinite(key))
    if len(at) > 4 * most:  # copies may be among them, so this is only a first cut
        bound = np.partition(key[at], 4 * most - 1)[4 * most - 1]
        cut = at[key[at] <= bound]
        got = _least(key[cut], x[cut], most) if len(cut) < len(at) else None
        if got is not None and len(got[0]) == most:
            return got
    h = content(x[at])
    order = np.lexsort((h, key[at]))
    at, h = at[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (key[at][1:] != key[at][:-1])) if len(at) else np.zeros(0, bool)
    at = at[new][:most]
    return key[at], x[at]


def _candidates(x: np.ndarray, dist: np.ndarray | None, k: int, seed: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of a round's draw."""
    return _least(exponential(content(x), np.ones(len(x)) if dist is None else dist, seed, step), x, 2 * k)


def _farthest(x: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _least(np.where(dist > 0, -dist, np.inf), x, FAR)


def _ended(step: int, wcss: float, before: float, max_iters: int, tol: float) -> bool:
    return step >= max_iters or step > 1 and (before <= 0 or (before - wcss) / before < tol)


def _starts(points: np.ndarray, weights: np.ndarray, k: int, seed: int, strict: bool) -> np.ndarray:
    return seed_centroids(points, k, np.random.default_rng(seed), strict, np.maximum(weights, 1).astype(np.float64))


def fit(x: np.ndarray, k: int, *, max_iters: int = 25, tol: float = 1e-4, seed: int = 42, strict: bool = False, largest: float | None = None) -> Fit:
    """Lloyd's algorithm. With k rows or fewer, each is its own centroid and the last fills up. Assignments and wcss belong to the centroids before the last update.

    largest: no coordinate is further from 0; sums have BITS bits below it.
    """
    if k < 1:
        raise KmeansBudgetTooSmall("k must be positive")
    if not len(x):
        raise EmptyVectorSet("there are no vectors")
    x = np.asarray(x, np.float64)
    if k >= len(x):
        return Fit(np.concatenate([x, np.repeat(x[-1:], k - len(x), 0)]), np.arange(len(x)), 0.0, 0)
    largest = float(np.abs(x).max()) if largest is None else largest
    points = _candidates(x, None, k, seed, 0)[1]
    for step in range(1, ROUNDS):
        points = np.unique(np.concatenate([points, _candidates(x, nearest(x, points)[1], k, seed, step)[1]]), axis=0)
    points = np.unique(points, axis=0)
    centroids = _starts(points, np.bincount(nearest(x, points)[0], minlength=len(points)), k, seed, strict)
    before = math.inf
    for step in range(1, max_iters + 1):
        own, dist = nearest(x, centroids)
        sums = Sums.none(k, x.shape[1])
        for a in range(0, len(x), 1 << 16):
            sums.add(x[a : a + (1 << 16)], own[a : a + (1 << 16)], dist[a : a + (1 << 16)], largest)
        wcss = sums.wcss(largest, x.shape[1])
        centroids = sums.moved(centroids, _farthest(x, dist)[1] if (sums.n == 0).any() else x[:0], largest)
        if _ended(step, wcss, before, max_iters, tol):
            break
        before = wcss
    return Fit(centroids, own, wcss, step)


# Groups that are too large for a task


def pack(rows: DataFrame) -> DataFrame:
    """Blocks (group, n, x, doc_id, pos) of rows (group, doc_id, pos, vec), the last four packed, made where the rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        count: dict[int, int] = {}

        def block(group: int) -> pa.RecordBatch:
            x, doc, pos = (np.concatenate(c) for c in zip(*held.pop(group), strict=True))
            del count[group]
            cut = range(0, len(x), BLOCK_ROWS)
            packed = [[v[a : a + BLOCK_ROWS].tobytes() for a in cut] for v in (x, doc, pos)]
            return pa.RecordBatch.from_arrays([pa.array([group] * len(cut), pa.int64()), pa.array([len(x[a : a + BLOCK_ROWS]) for a in cut], pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["group", "n", "x", "doc_id", "pos"])

        for batch in batches:
            if not len(batch):
                continue
            group = batch.column("group").to_numpy()
            own = matrix(batch.column("vec")), batch.column("doc_id").to_numpy(), batch.column("pos").to_numpy()
            for g in np.unique(group).tolist():
                at = group == g
                held.setdefault(g, []).append(tuple(v[at] for v in own))
                count[g] = count.get(g, 0) + int(at.sum())
                if count[g] >= BLOCK_ROWS:
                    yield block(g)
            if sum(count.values()) > PACK_ROWS:
                for g in list(held):
                    yield block(g)
        for g in list(held):
            yield block(g)

    return rows.select("group", "doc_id", "pos", "vec").mapInArrow(run, "group long, n int, x binary, doc_id binary, pos binary")


_STATE = "group long, sub int, k int, seed long, largest double, dim int, points binary, last binary, wcss double, step int, done boolean"
_PARTS = "group long, sub int, place int, n long, hi array<long>, lo array<long>, most int, key double, raw array<double>"
#: What rows of _PARTS hold whose place is none: summed squared distances; rows of least key.
_SPREAD, _ROWS = -1, -2


def _points(binary: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(binary, np.float64).reshape(-1, dim)


def _parts(group: int, sub: int, *, sums: Sums | None = None, rows: tuple[np.ndarray, np.ndarray] | None = None, most: int = 0, dim: int = 0) -> pa.RecordBatch:
    place, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hi = lo = np.zeros((0, dim), np.int64)
    key, raw = np.zeros(0), np.zeros((0, dim))
    if sums is not None:
        place = np.append(np.flatnonzero(sums.n), _SPREAD)
        n = np.append(sums.n[place[:-1]], sums.n.sum())
        spread = np.zeros((2, 1, dim), np.int64)
        spread[:, 0, 0] = sums.spread
        hi, lo = (np.concatenate([v[place[:-1]], s]) for v, s in ((sums.hi, spread[0]), (sums.lo, spread[1])))
    if rows is not None and len(rows[0]):
        key, raw = rows
    m, r = len(place), len(key)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(m + r, group)),
            pa.array(np.full(m + r, sub, np.int32)),
            pa.array(np.append(place, np.full(r, _ROWS)).astype(np.int32)),
            pa.array(np.append(n, np.zeros(r, np.int64))),
            lists(np.concatenate([hi, np.zeros((r, dim), np.int64)])),
            lists(np.concatenate([lo, np.zeros((r, dim), np.int64)])),
            pa.array(np.full(m + r, most, np.int32)),
            pa.array(np.append(np.zeros(m), key)),
            lists(np.concatenate([np.zeros((m, dim)), raw])),
        ],
        [c.strip().split(" ")[0] for c in _PARTS.split(",")],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up parts of the same (group, sub, place), and keeps the rows of least key."""
    parts: list[tuple[np.ndarray, ...]] = []
    size = 0

    def reduced() -> tuple[np.ndarray, ...]:
        group, sub, place, n, hi, lo, most, key, raw = (np.concatenate(c) for c in zip(*parts, strict=True))
        keep: list[np.ndarray] = []
        sums = place > _ROWS
        order = np.flatnonzero(sums)[np.lexsort((place[sums], sub[sums], group[sums]))]
        if len(order):
            same = (group[order][1:] == group[order][:-1]) & (sub[order][1:] == sub[order][:-1]) & (place[order][1:] == place[order][:-1])
            first = np.flatnonzero(np.append(True, ~same))
            n_, (hi_, lo_) = np.add.reduceat(n[order], first), _carried(np.add.reduceat(hi[order], first, axis=0), np.add.reduceat(lo[order], first, axis=0))
            at = order[first]
            n[at], hi[at], lo[at] = n_, hi_, lo_
            keep.append(at)
        of = np.stack([group[~sums], sub[~sums].astype(np.int64)], 1)
        rows = np.flatnonzero(~sums)
        for g, s in np.unique(of, axis=0).tolist():
            own = rows[(of[:, 0] == g) & (of[:, 1] == s)]
            own = own[np.lexsort((content(raw[own]), key[own]))]
            h = content(raw[own])
            keep.append(own[np.append(True, (h[1:] != h[:-1]) | (key[own][1:] != key[own][:-1]))][: int(most[own[0]])])
        at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        return tuple(c[at] for c in (group, sub, place, n, hi, lo, most, key, raw))

    for batch in batches:
        if not len(batch):
            continue
        wide = [matrix(batch.column(c)) if c == "raw" else batch.column(c).flatten().to_numpy().reshape(len(batch), -1) for c in ("hi", "lo", "raw")]
        plain = [np.array(batch.column(c).to_numpy()) for c in ("group", "sub", "place", "n", "most", "key")]
        parts.append((*plain[:4], wide[0], wide[1], plain[4], plain[5], wide[2]))
        size += 3 * wide[0].size
        if size > HELD:
            parts = [reduced()]
            size = 3 * parts[0][4].size
    if parts:
        group, sub, place, n, hi, lo, most, key, raw = reduced()
        yield pa.RecordBatch.from_arrays([*map(pa.array, (group, sub, place, n)), lists(hi), lists(lo), pa.array(most), pa.array(key), lists(raw)], [c.strip().split(" ")[0] for c in _PARTS.split(",")])


#: What a pass does with a block's rows in one sub-space: state, rows, nearest points and distances.
_Each = Callable[[dict, np.ndarray, np.ndarray, np.ndarray], None]


def _read(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Blocks with the states of their group's sub-spaces. A state has a row for each group and sub-space: Spark broadcasts it where it is small."""
    own = state.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("sub", "k", "seed", "largest", "dim", "points", "last", "step"))).alias("states"))
    return blocks.join(own, "group")


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[dict], int]]:
    for r in range(len(batch)):
        states = batch.column("states")[r].as_py()
        x = np.frombuffer(batch.column("x")[r].as_buffer(), np.float64).reshape(batch.column("n")[r].as_py(), -1)
        yield batch.column("group")[r].as_py(), x, states, r


def _draw(blocks: DataFrame, state: DataFrame, step: int) -> DataFrame:
    """The candidates of a round, as parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int, int]] = {}
        for batch in batches:
            for group, x, states, _ in _split(batch):
                for s in states:
                    dim, sub = s["dim"], s["sub"]
                    own = np.ascontiguousarray(x[:, sub * dim : (sub + 1) * dim])
                    points = _points(s["points"], dim)
                    got = _candidates(own, nearest(own, points)[1] if len(points) else None, s["k"], s["seed"], step)
                    if (group, sub) in found:
                        old = found[group, sub]
                        got = _least(np.append(old[0], got[0]), np.concatenate([old[1], got[1]]), 2 * s["k"])
                    found[group, sub] = (*got, 2 * s["k"], dim)
            if sum(f[1].size for f in found.values()) > HELD:
                yield from (_parts(g, b, rows=f[:2], most=f[2], dim=f[3]) for (g, b), f in found.items())
                found.clear()
        yield from (_parts(g, b, rows=f[:2], most=f[2], dim=f[3]) for (g, b), f in found.items())

    return _read(blocks, state).select("group", "n", "x", "states").mapInArrow(run, _PARTS)


def _add_up(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """The sums for the states' points, and the rows that are farthest from them where a point may be empty, as parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[Sums, tuple[np.ndarray, np.ndarray], int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (g, b), (sums, far, dim) in found.items():
                yield _parts(g, b, sums=sums, rows=far if (sums.n == 0).any() else None, most=FAR, dim=dim)
            found.clear()

        for batch in batches:
            for group, x, states, _ in _split(batch):
                for s in states:
                    dim, sub = s["dim"], s["sub"]
                    own = np.ascontiguousarray(x[:, sub * dim : (sub + 1) * dim])
                    points = _points(s["points"], dim)
                    at, dist = nearest(own, points)
                    sums, far, _ = found.get((group, sub)) or (Sums.none(len(points), dim), (np.zeros(0), np.zeros((0, dim))), dim)
                    sums.add(own, at, dist, s["largest"])
                    if (sums.n == 0).any():
                        more = _farthest(own, dist)
                        far = _least(np.append(far[0], more[0]), np.concatenate([far[1], more[1]]), FAR)
                    found[group, sub] = sums, far, dim
            if sum(3 * f[0].hi.size for f in found.values()) > HELD:
                yield from out()
        yield from out()

    return _read(blocks, state).select("group", "n", "x", "states").mapInArrow(run, _PARTS)


def _step(parts: DataFrame, state: DataFrame, change: Callable[[dict, Sums, np.ndarray], dict]) -> DataFrame:
    """The next state: change gives what is new in a row, from its sums and its rows of least key."""
    columns = [c.strip().split(" ")[0] for c in _STATE.split(",")]

    def one(own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0].to_dict()
        dim = int(row["dim"])
        sums, rows = Sums.none(max(len(_points(row["points"], dim)), 1), dim), np.zeros((0, dim))
        if len(met):
            place = met["place"].to_numpy()
            stack = lambda c, at: np.stack(met[c].to_numpy()[at]) if at.any() else np.zeros((0, dim))
            sums.n[place[place >= 0]] = met["n"].to_numpy()[place >= 0]
            for c, v in (("hi", sums.hi), ("lo", sums.lo)):
                v[place[place >= 0]] = stack(c, place >= 0)
                if (place == _SPREAD).any():
                    sums.spread["hi lo".split().index(c)] = stack(c, place == _SPREAD)[0][0]
            rows = met[place == _ROWS].sort_values("key", kind="stable")
            rows = np.stack(rows["raw"].to_numpy()) if len(rows) else np.zeros((0, dim))
        return pd.DataFrame([row | change(row, sums, rows)])[columns]

    merged = parts.repartition("group", "sub", "place").mapInArrow(_merge, _PARTS)
    return state.groupBy("group", "sub").cogroup(merged.groupBy("group", "sub")).applyInPandas(one, _STATE)


def fit_blocks(blocks: DataFrame, groups: DataFrame, dim: int, *, subs: int = 1, max_iters: int = 25, tol: float = 1e-4, strict: bool = False) -> DataFrame:
    """What fit() gives for each sub-space (of dim coordinates) of each of groups (group, k, seed, largest): rows (group, sub, k, points, last, dim, wcss, step).

    points are the centroids, packed; last those that assignments belong to. A sub-space's seed is the group's plus its number.
    Every group must have more rows than k.
    """
    none = F.lit(b"")
    start = groups.select("group", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))).alias("sub"), F.col("k").cast("int").alias("k"), "seed", "largest")
    state = materialize(start.select("group", "sub", "k", (F.col("seed") + F.col("sub")).alias("seed"), "largest", F.lit(dim).alias("dim"), none.alias("points"), none.alias("last"), F.lit(math.inf).alias("wcss"), F.lit(0).alias("step"), F.lit(False).alias("done")))

    def joined(row: dict, sums: Sums, rows: np.ndarray) -> dict:
        return {"points": np.unique(np.concatenate([_points(row["points"], dim), rows]), axis=0).tobytes()}

    for step in range(ROUNDS):
        state = materialize(_step(_draw(blocks, state, step), state, joined))

    def chosen(row: dict, sums: Sums, rows: np.ndarray) -> dict:
        return {"points": _starts(_points(row["points"], dim), sums.n, int(row["k"]), int(row["seed"]), strict).tobytes()}

    state = materialize(_step(_add_up(blocks, state), state, chosen))

    def moved(row: dict, sums: Sums, rows: np.ndarray) -> dict:
        points, wcss, step = _points(row["points"], dim), sums.wcss(row["largest"], dim), int(row["step"]) + 1
        return {"points": sums.moved(points, rows, row["largest"]).tobytes(), "last": row["points"], "wcss": wcss, "step": step, "done": _ended(step, wcss, row["wcss"], max_iters, tol)}

    while (open_ := state.where("NOT done")).limit(1).count():
        state = materialize(_step(_add_up(blocks, open_), open_, moved).unionByName(state.where("done")))
    return state


def assignments(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """group, doc_id, pos, local_k and dist of every packed row: the nearest of the points before the last update, and the distance from it after that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, x, (s,), r in _split(batch):
                at, _ = nearest(x, _points(s["last"], s["dim"]))
                dist = ((x - _points(s["points"], s["dim"])[at]) ** 2).sum(1)
                ids = [np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("doc_id", np.int64), ("pos", np.int32))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (np.full(len(x), group), *ids, at.astype(np.int32), dist))), ["group", "doc_id", "pos", "local_k", "dist"])

    return _read(blocks, state).mapInArrow(run, "group long, doc_id long, pos int, local_k int, dist double")


def centroid_rows(state: DataFrame) -> DataFrame:
    """group, sub, place and raw of the centroids of a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = _points(r["points"], r["dim"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), r["group"])), pa.array(np.full(len(c), r["sub"], np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), lists(c)], ["group", "sub", "place", "raw"])

    return state.select("group", "sub", "dim", "points").mapInArrow(run, "group long, sub int, place int, raw array<double>")
