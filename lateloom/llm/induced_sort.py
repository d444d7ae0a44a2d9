"""Suffix arrays of many strings by induced sorting, with queues that go to disk.

Suffixes that begin at a local minimum (leftmost of a run that then rises) are sorted first, by names of the substrings between
such places and by doubling of ranks, which ends early as only the first `depth` bytes count. From their order, one scan
over the symbols upwards induces the order of all suffixes that fall, and one downwards that of all that rise: a suffix that is taken
from its symbol's queue puts its left neighbour into that neighbour's queue. The queues are a priority queue over the symbols:
since suffixes are taken in order, each symbol's entries arrive in order. An entry carries, besides its place, how many symbols it
shares with the entry before it: one more than the least that neighbours shared between the two suffixes that induced them. What
exceeds a bound of memory is kept in an anonymous scratch file of the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queue entries that are held in memory: half of what the positions of a batch of suffix_dedup.SORT_BYTES take.
MEMORY = 4 << 20
#: The symbol after each string, and the one that is last of all; bytes are moved up by two.
END, LAST, BYTES = 1, 0, 2


Entries = tuple[np.ndarray, np.ndarray]  # places, and common prefixes with the entry before


def counts_of(depth: int) -> type:
    """The type of common prefixes of at most depth symbols."""
    return np.int16 if depth < 1 << 15 else np.int32


def _joined(blocks: list[Entries]) -> Entries:
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    return tuple(np.concatenate(c) for c in zip(*blocks, strict=True))


class Queues:
    """First-in-first-out queues of entries, one for each symbol, in blocks that go to disk beyond MEMORY bytes."""

    def __init__(self, symbols: int, memory: int | None = None) -> None:
        self.blocks: list[list[Entries | tuple[int, int, np.dtype]]] = [[] for _ in range(symbols)]
        self.held, self.memory = 0, MEMORY if memory is None else memory
        self.file = None

    def put(self, symbol: int, entries: Entries) -> None:
        size = entries[0].nbytes + entries[1].nbytes
        if self.held + size > self.memory:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115  it has no name, and goes with the task
            at = self.file.seek(0, 2)
            for x in entries:
                self.file.write(x.tobytes())
            self.blocks[symbol].append((at, len(entries[0]), entries[1].dtype))
        else:
            self.held += size
            self.blocks[symbol].append(entries)

    def take(self, symbol: int) -> Entries:
        out = []
        for b in self.blocks[symbol]:
            if isinstance(b[0], int):
                self.file.seek(b[0])
                out.append((np.frombuffer(self.file.read(8 * b[1]), np.int64), np.frombuffer(self.file.read(b[2].itemsize * b[1]), b[2])))
            else:
                self.held -= b[0].nbytes + b[1].nbytes
                out.append(b)
        self.blocks[symbol] = []
        return _joined(out)

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Scan:
    """One scan: what it takes in order induces left neighbours of one kind, with the symbols that these share."""

    def __init__(self, t: np.ndarray, left: np.ndarray, queue: Queues, depth: int) -> None:
        self.t, self.kind, self.queue, self.depth = t, left, queue, depth
        self.least = np.zeros(256 + BYTES, counts_of(depth))  # shared by all that was taken since a symbol's last entry; 0 without one
        self.seen = np.zeros(256 + BYTES, bool)

    def take(self, found: np.ndarray, shared: np.ndarray) -> None:
        """found: places in the scan's order; shared: with the place taken before."""
        if not len(found):
            return
        at = np.flatnonzero(found > 0)
        at = at[self.kind[found[at] - 1]]
        to = self.t[found[at] - 1]
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        common = np.empty(len(at), counts_of(self.depth))
        so_far = np.minimum.accumulate(shared)
        if len(at):
            inner = np.ones(len(at), bool)
            inner[cuts] = False
            k = np.flatnonzero(inner)
            common[k] = _range_minima(shared, at[k - 1] + 1, at[k] + 1)
            common[cuts] = np.minimum(self.least[to[cuts]], so_far[at[cuts]])
        self.least = np.minimum(self.least, so_far[-1])
        if len(at):
            last = np.append(cuts[1:], len(at)) - 1
            after = np.append(np.minimum.accumulate(shared[::-1])[::-1], counts_of(self.depth)(self.depth))
            self.least[to[last]] = after[at[last] + 1]
            common = np.where(to <= END, 0, np.minimum(common + 1, self.depth)).astype(counts_of(self.depth))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                if not self.seen[to[a]]:
                    self.seen[to[a]], common[a] = True, 0
                self.queue.put(int(to[a]), (found[at[a:b]] - 1, common[a:b]))


def _range_minima(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of x[begin:end] of each (not empty) range, by minima over powers of two."""
    out = np.empty(len(begin), x.dtype)
    level = np.log2(np.maximum(end - begin, 1)).astype(np.int64)
    table = x
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[begin[own]], table[end[own] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def _rising(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The last one, of LAST alone, counts as rising."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])  # the last place of each run
    ends = np.append(change, n - 1)
    up = np.append(t[change] < t[change + 1], True)
    return np.repeat(up, np.diff(np.append(-1, ends)))


def _words(t: np.ndarray) -> np.ndarray:
    """At each place, the next eight symbols' lowest eight bits after packing them as nine-bit digits: seven symbols, most significant first."""
    padded = np.concatenate([t.astype(np.uint64), np.zeros(7, np.uint64)])
    out = np.zeros(len(t), np.uint64)
    for k in range(7):
        out = (out << np.uint64(9)) | padded[k : k + len(t)]
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys (the first is the most significant), equal for equal rows."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _minima_order(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places at (ascending), sorted by their suffixes' first depth symbols at least."""
    n = len(t)
    if not len(at):
        return at
    words = _words(t)
    stop = np.append(at[1:], n - 1) + 1  # a substring ends with the next minimum
    length = np.maximum(stop - at, 1)
    rank = np.zeros(len(at), np.int64)
    full = np.uint64((1 << 63) - 1)
    for step in range(0, int(length.max()), 7):
        drop = (9 * (7 - np.clip(length - step, 0, 7))).astype(np.uint64)
        own = words[np.minimum(at + step, n - 1)] | ~(full << drop) & full  # of two that go on alike, the one that ends here rises
        rank = _dense(rank, np.where(length > step, own, full))
        if step >= depth:
            break
    reach, jump = max(int((length - 1)[:-1].min(initial=depth)), 1), 1
    while reach < depth and rank.max() < len(rank) - 1:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-jump or None] = rank[jump:] if jump < len(rank) else -1
        rank = _dense(rank, ahead)
        reach, jump = reach * 2, jump * 2
        if jump >= len(rank):
            break
    return at[np.argsort(rank, kind="stable")]


def suffix_array(t: np.ndarray, depth: int, memory: int | None = None) -> Entries:
    """Start places of all suffixes of t (its last symbol is LAST, and no other is), sorted by their first depth symbols at least, and how many of these, depth at most, each shares with the one before."""
    rising = _rising(t)
    minima = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    seeds = _minima_order(t, minima, depth)
    seed_shared = common_prefixes(t, seeds, depth).astype(counts_of(depth))
    symbols = 256 + BYTES
    bounds = np.searchsorted(t[seeds], np.arange(symbols + 1))

    def border(a: int, b: int) -> int:
        n = min(depth, len(t) - max(a, b))
        x, y = t[a : a + n], t[b : b + n]
        ends = np.flatnonzero((x != y) | (x <= END))
        return int(ends[0]) if len(ends) else n

    falling_queue, fallen, rising_queue = (Queues(symbols, memory) for _ in range(3))
    down = _Scan(t, ~rising, falling_queue, depth)
    for c in range(symbols):
        last = -1
        while len((found := falling_queue.take(c))[0]):
            last = int(found[0][-1])
            fallen.put(c, found)
            down.take(*found)
        own, shared = seeds[bounds[c] : bounds[c + 1]], seed_shared[bounds[c] : bounds[c + 1]].copy()
        if len(own):
            shared[0] = border(last, int(own[0])) if last >= 0 else 0
            down.take(own, shared)
    up = _Scan(t, rising, rising_queue, depth)
    out: list[Entries] = []
    for c in range(symbols - 1, -1, -1):
        least = -1  # the least that rises, the last to be taken
        while len((found := rising_queue.take(c))[0]):
            least = int(found[0][-1])
            out.append(found)
            up.take(*found)
        if c == LAST:
            least = len(t) - 1
            out.append((np.array([least], np.int64), np.zeros(1, counts_of(depth))))
        places, shared = (x[::-1] for x in fallen.take(c))
        if len(places):  # each shares with the one before that in this order, the greater, what that one carries
            shared = np.append(counts_of(depth)(border(int(places[0]), least) if least >= 0 else 0), shared[:-1])
            out.append((places, shared))
            up.take(places, shared)
    for q in (falling_queue, fallen, rising_queue):
        q.close()
    places, shared = _joined(out)
    return places[::-1], np.append(np.zeros(1, counts_of(depth)), shared[1:][::-1])


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many symbols (depth at most) each suffix of order shares with the one before it; END and LAST are shared with nothing."""
    n = len(t)
    words = _words(t)
    ends = np.flatnonzero(t <= END)
    room = ends[np.searchsorted(ends, order)] - order  # up to the string's end
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    done = 0
    while len(live) and done < depth:
        a, b = order[live] + done, order[live - 1] + done
        same = (words[np.minimum(a, n - 1)] == words[np.minimum(b, n - 1)]) & (a < n) & (b < n)
        stopped = live[~same]
        if len(stopped):
            x, y = order[stopped] + done, order[stopped - 1] + done
            k = np.zeros(len(stopped), np.int64)
            on = np.ones(len(stopped), bool)
            for j in range(7):
                on &= (x + j < n) & (y + j < n)
                on &= t[np.minimum(x + j, n - 1)] == t[np.minimum(y + j, n - 1)]
                k += on
            out[stopped] = done + k
        live = live[same]
        out[live] = done + 7
        done += 7
    return np.minimum(np.minimum(out, depth), np.minimum(room, np.append(0, room[:-1])))
