"""Token counts by a two-tier lookup on the map side.

A pre-token here is a run of characters without white space: the tokenizer drops white space, never joins what it parts,
and looks for its special strings, which have none, before anything else; so a text's count is the sum over its runs.
Tier one is a compact table of the lengths of the most frequent runs, broadcast; tier two is a cache in each worker, which
encodes a run that it misses by the tokenizer itself. Pre-tokens never enter a shuffle: the frequent ones are found from
each task's own heavy hitters, of which at most TASK_HITTERS leave a task.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held, release

#: Heavy hitters that leave a task; entries of the broadcast table; entries of a worker's cache, which then starts anew.
TASK_HITTERS, TABLE_ENTRIES, CACHE_ENTRIES = 4096, 16384, 500_000
#: Longest run of characters that is kept in a table or a cache.
LONGEST = 64

#: Where str.split and a tokenizer may not agree on what white space is; a text with one of these is encoded whole.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")

def counter(path: str) -> Callable[[str], int]:
    """A function that counts a text's tokens as the library for the file at path gives them. path must be readable where it is called."""
    kind = path.rpartition(".")[2]
    if kind == "json":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda s: len(t.encode(s, add_special_tokens=False).ids)
    if kind == "model":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda s: len(p.encode(s, num_threads=1))
    raise ValueError(f"neither a .json nor a .model file: {path}")


def additive(path: str) -> bool:
    """Whether a text's count is the sum over its runs: the tokenizer first parts at white space and drops it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        pre = json.load(f)["pre_tokenizer"] or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s" in first["pattern"].get("Regex", "")


class Lengths(dict):
    """Lengths of runs: begins as the broadcast table, learns what it misses, and returns to the table when full."""

    def __init__(self, frequent: dict[str, int], path: str) -> None:
        super().__init__(frequent)
        self.frequent, self.count, self.additive = frequent, counter(path), additive(path)

    def __missing__(self, run: str) -> int:
        n = self.count(run)
        if len(run) <= LONGEST:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[run] = n
        return n

    def total(self, text: str) -> int:
        if not self.additive or _RARE_SPACE.search(text):
            return self.count(text)
        return sum(map(self.__getitem__, text.split()))


def frequent_runs(docs: DataFrame, text: str = "text") -> list[str]:
    """The runs that most texts' tasks found frequent. Counted over all texts; a task keeps and sends its heavy hitters only."""

    def hitters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(t.split() if t else ())
                if len(seen) > 64 * TASK_HITTERS:
                    seen = Counter(dict(seen.most_common(8 * TASK_HITTERS)))
        top = [(w, n) for w, n in seen.most_common(TASK_HITTERS) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["run", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(hitters, "run string, n long")
    rows = found.groupBy("run").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "run").limit(TABLE_ENTRIES)
    return [r["run"] for r in rows.collect()]


def count_tokens(docs: DataFrame, path: str, *, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit for every row of docs, whole texts.

    A null or empty text has no bytes and no tokens. Repeated rows stay. Further columns are not read.
    """
    count = counter(path)
    frequent = frequent_runs(docs, text) if additive(path) else []
    tiers = docs.sparkSession.sparkContext.broadcast({w: count(w) for w in frequent})

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = held("lengths", tiers.value, lambda: Lengths(tiers.value, path))
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n = [cache.total(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.binary()), pa.array(n, pa.int64())], ["key", "raw", "n_tokens"])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in lengths(batches):
            size = pc.cast(pc.binary_length(b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, b.column(2), pc.greater(b.column(2), limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sized, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
