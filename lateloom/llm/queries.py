"""The thin queries opN_<name> over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, ngram_join, packing, pii, sharding, source_audit, suffix_dedup, token_alignment, token_counts, topk_search, toxicity, url_filters
from ._shared import small_batches, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, percent=80)


def op2_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), most=1024, end_id=2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200, keep=("doc_id",))


RULES = [
    url_filters.Rule("org", "/", "allow"),
    url_filters.Rule("example.org", "/es/", "block"),
    url_filters.Rule("example.org", "/en/1", "block"),
    url_filters.Rule("com", "/fr/", "allow"),
    url_filters.Rule("com", "/de/", "block"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"), least=3, top=200)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_scores(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_identifiers(table(spark, sf_dir, "documents"))

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(of: Column, kind: str) -> Column:
        return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    plain = F.filter("spans", lambda s: ~s["disguised"])
    counts = [count(plain, kind) for kind in pii.KINDS]
    disguised = F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised")
    return found.select("doc_id", *counts, F.sha2(shown(plain), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), disguised)


Query = Callable[[SparkSession, str], DataFrame]


def _batched(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, Query] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_exact_topk_search": op2_exact_topk_search,
    "op3_html_extraction": op3_html_extraction,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_alignment": op12_token_alignment,
    "op13_pii": op13_pii,
}
QUERIES = {name: _batched(query) for name, query in _ALL.items()}

_OP10 = r"""
WITH urls AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path
  FROM urls
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN LATERAL (
  SELECT rule_host || rule_path AS rule, verdict FROM rules
  WHERE (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY length(rule_host || rule_path) DESC LIMIT 1
) best ON true
"""

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"
_OP1 = f"""
WITH i AS (SELECT item_id, ws, least(5, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark)),
ig AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM i WHERE k > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM ig))),
n AS (SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY 1),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM s JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_shingles
"""

_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), own AS (
  SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(langs.n, 0) AS lang_n, coalesce(own_n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS own_n FROM own GROUP BY ALL) USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, CAST(1 + 1000000000 * CAST(coalesce(c, 0) + 1 AS HUGEINT) // (g.n + g.v) AS HUGEINT) AS p, CAST(1 + 1000000000 * CAST(k.total + 1 AS HUGEINT) // (g.lang_n + g.v) AS HUGEINT) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN own USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right('000' || x, 3) AS INTEGER) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(dg)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(dg, length(dg) - i, 1) AS INTEGER) ELSE 2 * CAST(substr(dg, length(dg) - i, 1) AS INTEGER) - CASE WHEN CAST(substr(dg, length(dg) - i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(dg) BETWEEN 8 AND 15"),
}
_FOUND = "\nUNION ALL\n".join(f"SELECT r, '{kind}' AS kind, {nr} AS nr, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS parts FROM d" for nr, (kind, (p, _)) in enumerate(_KINDS.items()))
#: The given tables have no disguised data, so all spans are plain ones, which SQL can find; those that the method adds are tested on planted cases.
_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
e AS (SELECT *, unnest(found) AS s, unnest(range(1, len(found) + 1)) AS i FROM f WHERE len(found) > 0),
p AS (SELECT r, kind, nr, s, regexp_replace(s, '[^0-9]', '', 'g') AS dg, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b FROM e),
k AS (SELECT * FROM p WHERE CASE kind {' '.join(f"WHEN '{kind}' THEN {ok}" for kind, (_, ok) in _KINDS.items())} END),
g AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _KINDS)}, string_agg(kind || ':' || b || ':' || (b + length(s)), ',' ORDER BY nr, b) AS spans FROM k GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _KINDS)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(0 AS BIGINT) AS n_disguised FROM d LEFT JOIN g USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_benchmark_decontamination": _OP1, "op2_exact_topk_search": _OP2, "op10_url_filters": _OP10, "op11_source_divergence": _OP11, "op13_pii": _OP13}
