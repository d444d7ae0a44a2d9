"""URL filters: a trie over reversed host labels and then path segments, with longest-match precedence between allow and block entries.

The trie is built on the driver from the rules, which are a parameter and whose total size is checked, and is
broadcast; every url walks it once. Nothing is shuffled. Rules of any size come as a table: beyond the trie's bound urls meet them in
joins, by the ends of their host and by the lengths of path that rules for such a host have.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, temporary

#: Most characters of all rules together: what is broadcast stays under about a hundred times that in bytes.
MAX_RULE_CHARS = 4_000_000

_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """An entry: its host, whose subdomains it covers too, the start that a path must have, and allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    paths: _Path | None = None


@dataclass
class _Path:
    """Whole segments lead to further nodes; what an entry's last segment begins with is in begins, longest first."""

    segments: dict[str, _Path] = field(default_factory=dict)
    begins: dict[str, Rule] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


class RuleTrie:
    def __init__(self, rules: Iterable[Rule]) -> None:
        """Of two rules for the same host and path, block holds."""
        rules = list(rules)
        if sum(len(r.text) for r in rules) > MAX_RULE_CHARS:
            raise ValueError(f"the rules have more than {MAX_RULE_CHARS} characters")
        if bad := [r for r in rules if r.verdict not in ("allow", "block")]:
            raise ValueError(f"neither allow nor block: {bad[0]}")
        self.root = _Node()
        for r in rules:
            node = self.root
            for label in reversed(r.host.translate(_ASCII_LOWER).split(".")):
                node = node.labels.setdefault(label, _Node())
            here = node.paths = node.paths or _Path()
            *whole, last = r.path.split("/")
            for segment in whole:
                here = here.segments.setdefault(segment, _Path())
            if (old := here.begins.get(last)) is None or old.verdict == "allow":
                here.begins[last] = r
            if len(last) not in here.lengths:
                here.lengths = sorted([*here.lengths, len(last)], reverse=True)

    def longest(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits, by the characters of host and path; of two as long, the one with the longer host."""
        best: Rule | None = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            here = node.paths
            for segment in segments:
                if here is None:
                    break
                for n in here.lengths:
                    if n <= len(segment) and (found := here.begins.get(segment[:n])):
                        if best is None or len(found.text) >= len(best.text):
                            best = found
                        break
                here = here.segments.get(segment)
        return best


def split_url(url: str | None) -> tuple[str, str]:
    found = _HOST.search(url or "")
    return (found[1].translate(_ASCII_LOWER), found[2]) if found else ("", "")


def judge_urls(pages: DataFrame, rules: Iterable[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict for every row of pages.

    A null url, or one without ``://``, has empty host and path, no rule and the default verdict; repeated rows stay,
    each with its verdict; further columns of pages are not read.
    """
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, texts, verdicts = [], [], [], []
            for u in batch.column(1).to_pylist():
                host, path = split_url(u)
                rule = trie.value.longest(host, path)
                hosts.append(host)
                paths.append(path)
                texts.append(rule.text if rule else None)
                verdicts.append(rule.verdict if rule else default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, texts, verdicts))], ["key", "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def judge_by_table(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow", max_chars: int = MAX_RULE_CHARS) -> DataFrame:
    """As judge_urls, by a table of rules (host, path, verdict) of any size. A rule with a null column is none."""
    own = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    if (own.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0) <= max_chars:
        return judge_urls(pages, [Rule(*r) for r in own.collect()], key=key, url=url, default=default)  # of max_chars at most
    if (bad := own.where("verdict NOT IN ('allow', 'block')").first()) is not None:
        raise ValueError(f"neither allow nor block: {bad}")
    upper, lower = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    with temporary() as result:
        rows = pages.select(F.col(key).alias("key"), F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), upper, lower).alias("host"), F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1).alias("path"))
        rows = result(rows.withColumn("row", F.monotonically_increasing_id()))
        blocks = (F.col("verdict") == "block").alias("blocks")
        known = own.groupBy(F.translate("host", upper, lower).alias("end"), F.col("path").alias("begin")).agg(F.max(F.struct(blocks, "host")).alias("of"))  # of two, block holds
        known = materialize(known.select("end", "begin", "of.blocks", F.concat("of.host", "begin").alias("rule")))
        lengths = known.select("end", F.length("begin").alias("n")).distinct()
        ends = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, 1 << 30), "."))
        tried = rows.select("row", "path", F.explode(ends).alias("end")).join(lengths, "end").where("n <= length(path)").select("row", "end", F.expr("substring(path, 1, n)").alias("begin"))
        fits = tried.join(known, ["end", "begin"])
        best = result(fits.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("end").alias("m"), "rule", "blocks")).alias("best")))
    judged = rows.join(best, "row", "left")
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocks"), "block").otherwise("allow")
    return judged.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
