"""Helpers that several operators of this subpackage use: shared storage, text buffers and shingle hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs on one machine (tests), an own one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='lateloom-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors, runs df once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lateloom/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(forget)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a table, as far as its session still lives; else its folder goes with the cluster's clean-up."""
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget() -> None:
    """Deletes what materialize() wrote and no temporary() has deleted."""
    while _written:
        _delete(*_written.pop())


@contextlib.contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at the end. What is needed beyond goes through the function that this gives: a table that stays."""
    mark, stay = len(_written), []

    def result(df: DataFrame) -> DataFrame:
        out = materialize(df)
        stay.append(_written.pop())
        return out

    try:
        yield result
    finally:
        own = _written[mark:]
        _written[mark:] = stay
        for table_ in own:
            _delete(*table_)


def tables() -> list[str]:
    """The paths of tables that have not been deleted."""
    return [path for _, path in _written]


def discard(paths: list[str]) -> None:
    """Deletes those of tables() that are in paths."""
    for table_ in [t for t in _written if t[1] in paths]:
        _written.remove(table_)
        _delete(*table_)


#: Rows of a batch between the JVM and Python workers: with texts of some kB, some MB.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS, unless the session has chosen a number of its own: Spark's default holds tens of MB of texts several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


_held: dict[str, tuple[Any, Any]] = {}


def held(owner: str, of: Any, make: Callable[[], Any]) -> Any:  # noqa: ANN401
    """What make() gives for the object of, kept in a worker until an operator asks for something else: caches of others go then.

    The object itself is held, so that no other can be taken for it; paths are compared by value.
    """
    found = _held.get(owner)
    if found is None or not (found[0] is of or isinstance(of, str) and found[0] == of):
        release()
        _held[owner] = found = (of, make())
    return found[1]


def release() -> None:
    """Gives back what a worker's caches and allocators hold: an operator that keeps nothing begins with it."""
    _held.clear()
    _powers[:] = _ONES
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a column of strings or UTF-8 (null: empty) into runs of rows of at most limit bytes or one row: first row, row after the last, bytes, offsets from 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    n = len(array)
    if not n:
        return
    off = np.frombuffer(offsets, np.int64, n + 1 + array.offset)[array.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_ONES = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_powers: list[np.ndarray] = list(_ONES)
#: Powers that are kept; longer texts compute their own.
_KEEP_POWERS = 1 << 21


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, _INVERSE):
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x, out=x))
    if n <= _KEEP_POWERS:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], times the inverse base to the power i, a hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a word: white space of ASCII ...
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: ... or all of ASCII but letters and digits.
MARKS = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])


def words(data: np.ndarray, off: np.ndarray, ends_word: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, A-Z lower-cased, and the number of words before each text (and of all)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    x = _LOWER[data]
    inside = ~ends_word[x]
    first = np.zeros(n + 1, bool)
    first[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    begin, end = np.flatnonzero(starts), np.flatnonzero(last) + 1
    p = prefix_hash(x)
    got = (p[end] - p[begin]) * powers(n)[1][begin]
    return mix(got ^ (end - begin).astype(np.uint64)), np.searchsorted(begin, off).astype(np.int64)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words inside one text, and how many come before each text. A text with fewer words, but at least one, gives its whole sequence."""
    n = len(hashes)
    count = np.diff(at)
    windows = np.maximum(count - size + 1, 0)
    short = (count > 0) & (count < size)
    total = np.zeros(len(at), np.int64)
    np.cumsum(windows + short, out=total[1:])
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for t in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[t : n - size + 1 + t]
        keep = np.zeros(n + 1, np.int32)
        full = np.flatnonzero(windows)
        np.add.at(keep, at[full], 1)
        np.add.at(keep, at[full] + windows[full], -1)
        h = mix(h[np.cumsum(keep[: n - size + 1]) > 0])
    else:
        h = np.empty(0, np.uint64)
    if not short.any():
        return h, total
    out = np.empty(total[-1], np.uint64)
    place = np.ones(total[-1], bool)
    for d in np.flatnonzero(short):
        place[total[d]] = False
        v = np.zeros(1, np.uint64)
        for w in hashes[at[d] : at[d + 1]]:
            v = v * np.uint64(0xD6E8FEB86659FD93) + w
        out[total[d]] = mix(v ^ np.uint64(0xA5A5A5A5))[0]
    out[place] = h
    return out, total


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
