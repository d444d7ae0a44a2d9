"""The same queries in SQL, for an independent engine to check: common table expressions, put together as each query needs them."""

from __future__ import annotations

_TOKENS = r"string_split_regex(lower(coalesce(text, '')), '\s+')"
_WORD_LIST = rf"list_filter(list_transform({_TOKENS}, lambda w: regexp_replace(w, '[.,!?;:-]+$', '')), lambda w: w <> '')"

_VIEWS = {
    "e": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "tok": "SELECT vec_id // 10 AS doc_id, CAST(vec_id % 10 AS INTEGER) AS pos, CAST(label AS BIGINT) AS token_id, v AS vec FROM e",
    "fine": "SELECT vec_id // 10 AS doc_id, CAST(vec_id % 10 AS INTEGER) AS pos, vec_id % 125 AS token_id, v AS vec FROM e",
    "asked": "SELECT *, vec_id // 50 + 1 AS qid, CAST(vec_id % 50 - 8 * (vec_id // 50 % 2) AS INTEGER) AS qpos FROM e",
    "qt": "SELECT qid, qpos, v AS vec FROM asked WHERE qpos BETWEEN 0 AND 3",
    "qrels": "SELECT qid, vec_id // 10 AS doc_id, CAST(count(*) AS INTEGER) AS rel FROM asked WHERE qpos BETWEEN 0 AND 3 GROUP BY 1, 2",
    "pairs": "SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.v AS a, b.v AS b FROM e a, e b WHERE a.vec_id % 50 = 0",
    # budgets
    "spread": "SELECT token_id, max(n) AS n_j, round(sum(s), 9) AS s_j FROM (SELECT token_id, d, count(*) AS n, var_pop(x) AS s FROM (SELECT token_id, unnest(vec) AS x, unnest(range(64)) AS d FROM tok) GROUP BY 1, 2) GROUP BY 1",
    "tiers": "SELECT *, CASE WHEN n_j = 0 THEN 'empty' WHEN n_j < 46 THEN 'micro' WHEN n_j < 50 THEN 'small' ELSE 'active' END AS tier FROM spread",
    "tails": "SELECT *, CAST(CASE tier WHEN 'micro' THEN 1 WHEN 'small' THEN 2 ELSE 0 END AS BIGINT) AS k_tail FROM tiers",
    "kappa": "SELECT 50 AS kappa",
    "left_over": "SELECT t.*, CAST(kappa - sum(k_tail) OVER () AS BIGINT) AS left_over, CASE WHEN tier = 'active' THEN sqrt(n_j) * s_j ELSE 0 END AS w FROM tails t, kappa",
    "shares": "SELECT *, CASE WHEN tier = 'active' THEN w / sum(w) OVER () * left_over ELSE 0 END AS target FROM left_over",
    "damped": "SELECT *, CASE WHEN tier = 'active' THEN CAST(floor(target) AS BIGINT) ELSE 0 END AS k_damped, CAST(CASE WHEN tier = 'active' THEN target - floor(target) ELSE 0 END AS FLOAT) AS frac FROM shares",
    "bounded": "SELECT *, CASE WHEN tier = 'active' THEN least(greatest(k_damped, 2), n_j // 5) ELSE k_tail END AS k_bounded FROM damped",
    "gaps": "SELECT b.*, kappa - sum(k_bounded) OVER () AS gap FROM bounded b, kappa",
    "rooms": """SELECT *, CASE WHEN tier = 'active' THEN greatest(n_j // 5 - k_bounded, 0) ELSE 0 END AS up,
        CASE WHEN tier = 'active' THEN greatest(k_bounded - 2, 0) ELSE 1 END AS down, CASE tier WHEN 'active' THEN 0 WHEN 'small' THEN 1 ELSE 2 END AS stage,
        CASE WHEN tier = 'active' THEN frac ELSE 0 END AS part FROM gaps""",
    "moves": """SELECT *, coalesce(sum(up) OVER (ORDER BY part DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up_before,
        coalesce(sum(down) OVER (ORDER BY stage, part, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS down_before FROM rooms""",
    "budgets": """SELECT token_id, tier, CAST(k_bounded + CASE WHEN gap > 0 THEN greatest(0, least(up, gap - up_before)) ELSE 0 END
        - CASE WHEN gap < 0 THEN greatest(0, least(down, -gap - down_before)) ELSE 0 END AS BIGINT) AS kappa_j FROM moves""",
    # centroids
    "comp": "SELECT token_id, d, round(avg(x), 9) AS x FROM (SELECT token_id, unnest(vec) AS x, unnest(range(64)) AS d FROM fine) GROUP BY 1, 2",
    "raws": "SELECT token_id, list(x ORDER BY d) AS raw FROM comp GROUP BY 1",
    "cent": "SELECT CAST(row_number() OVER (ORDER BY token_id) - 1 AS INTEGER) AS centroid_id, token_id, raw, list_transform(raw, lambda x: round(x / sqrt(list_dot_product(raw, raw)), 9)) AS unit FROM raws",
    "ft": "SELECT f.*, c.centroid_id, c.raw, c.unit FROM fine f JOIN cent c USING (token_id)",
    "postings": "SELECT DISTINCT centroid_id, doc_id FROM ft",
    # residuals and codes
    "parts": "SELECT doc_id, pos, centroid_id, unnest(range(64)) AS d, unnest(vec) AS x, unnest(raw) AS c FROM ft",
    "lengths": "SELECT doc_id, pos, centroid_id, sqrt(sum((x - c) * (x - c) ORDER BY d)) AS n FROM parts GROUP BY 1, 2, 3",
    "units": "SELECT p.doc_id, p.pos, p.centroid_id, p.d, CASE WHEN n = 0 THEN round(x - c, 9) ELSE round((x - c) / n, 9) END AS u FROM parts p JOIN lengths USING (doc_id, pos)",
    "norms": "SELECT doc_id, pos, centroid_id, round(n, 9) AS residual_norm FROM lengths",
    "size": "SELECT count(*) AS rows_all FROM fine",
    "book": "SELECT CAST(d // 2 AS INTEGER) AS m, CAST((doc_id * 10 + pos) * 256 // rows_all AS INTEGER) AS code, CAST(d % 2 AS INTEGER) AS d, u AS x FROM units, size WHERE (doc_id * 10 + pos) * 256 % rows_all < 256",
    "book2": "SELECT m, code, max(x) FILTER (d = 0) AS c0, max(x) FILTER (d = 1) AS c1 FROM book GROUP BY 1, 2",
    "unit2": "SELECT doc_id, pos, CAST(d // 2 AS INTEGER) AS m, max(u) FILTER (d % 2 = 0) AS u0, max(u) FILTER (d % 2 = 1) AS u1 FROM units GROUP BY 1, 2, 3",
    "codes": "SELECT doc_id, pos, m, CAST(arg_min(code, (dist, code)) AS INTEGER) AS code FROM (SELECT doc_id, pos, u.m, code, (u0 - c0) * (u0 - c0) + (u1 - c1) * (u1 - c1) AS dist FROM unit2 u JOIN book2 b ON u.m = b.m) GROUP BY 1, 2, 3",
    "decoded": "SELECT doc_id, pos, CAST(c.m * 2 + b.d AS INTEGER) AS d, b.x FROM codes c JOIN book b ON c.m = b.m AND c.code = b.code",
    "cparts": "SELECT centroid_id, unnest(range(64)) AS d, unnest(unit) AS cu FROM cent",
    "recon": "SELECT t.doc_id, t.pos, CAST(t.d AS INTEGER) AS d, cu + residual_norm * t.x AS x FROM decoded t JOIN norms n ON t.doc_id = n.doc_id AND t.pos = n.pos JOIN cparts c ON c.centroid_id = n.centroid_id AND c.d = t.d",
    "rvec": "SELECT doc_id, pos, list(x ORDER BY d) AS vec FROM recon GROUP BY 1, 2",
    # retrieval
    "sims": "SELECT qid, qpos, centroid_id, round(list_dot_product(q.vec, c.unit), 9) AS sim FROM qt q, cent c",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY qid, qpos ORDER BY sim DESC, centroid_id) AS INTEGER) AS rank FROM sims",
    "depth": "SELECT 16 AS kappa_c",
    "gathered": "SELECT qid, doc_id, sum(sim) AS raw_score FROM (SELECT qid, qpos, doc_id, max(sim) AS sim FROM ranked r JOIN postings p USING (centroid_id), depth WHERE rank <= kappa_c GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "scores": "SELECT qid, doc_id, round(raw_score, 9) AS score FROM gathered",
    "places": "SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM scores",
    "pruned": "SELECT * FROM places WHERE rank <= 20",
    "exact": "SELECT qid, doc_id, round(sum(sim), 9) AS score FROM (SELECT qid, qpos, doc_id, max(list_dot_product(q.vec, t.vec)) AS sim FROM qt q, tok t GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "exact_top": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM exact) WHERE rank <= 10",
    "kept": "SELECT * FROM pruned",
    "refined": "SELECT qid, doc_id, round(sum(sim), 9) AS score FROM (SELECT k.qid, k.doc_id, qpos, max(list_dot_product(q.vec, r.vec)) AS sim FROM kept k JOIN qt q USING (qid) JOIN rvec r ON r.doc_id = k.doc_id GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "found": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM refined) WHERE rank <= 10",
    # text
    "lines": r"""SELECT concat_ws(chr(9), qid, doc_id, rel) AS value FROM qrels UNION ALL SELECT concat_ws(chr(9), qid, 0, doc_id, rel) FROM qrels
        UNION ALL SELECT unnest(['# header' || chr(13), '901 0' || chr(13), '902' || chr(9) || '1768' || chr(13), '', '903', '904 1 2 3 4', '905  7   2', '906 0 8 0', '907 x', '908 0 y 1', '   '])""",
    "fields": r"SELECT list_filter(string_split_regex(line, '[\t ]+'), lambda x: x <> '') AS f FROM (SELECT regexp_replace(value, '\r$', '') AS line FROM lines) WHERE line <> '' AND NOT starts_with(line, '#')",
    "typed": "SELECT len(f) AS n, try_cast(f[1] AS BIGINT) AS qid, try_cast(CASE WHEN len(f) = 4 THEN f[3] ELSE f[2] END AS BIGINT) AS doc_id, try_cast(CASE len(f) WHEN 2 THEN '1' WHEN 3 THEN f[3] WHEN 4 THEN f[4] END AS INTEGER) AS rel FROM fields",
    "lenient": "SELECT qid, doc_id, rel, CASE WHEN n NOT BETWEEN 2 AND 4 THEN 'columns' WHEN rel IS NULL THEN 'relevance' WHEN rel < 1 THEN NULL WHEN qid IS NULL OR doc_id IS NULL THEN 'id' END AS error FROM typed",
    "docwords": rf"SELECT doc_id, {_WORD_LIST} AS ws FROM documents",
    "words": "SELECT doc_id, unnest(ws) AS word FROM docwords",
}

_ORDER = list(_VIEWS)


def _sql(select: str, **other: str) -> str:
    """A query over the views that it needs, directly or not; other views replace those of their names."""
    import re

    views = {**_VIEWS, **other}
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(views[name])
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in _ORDER if n in needed) + "\n" + select


_RANKS = "SELECT qid, rank, doc_id, round(score, 6) + 0.0 AS score FROM"
_NEAREST = "SELECT f.doc_id, f.pos, f.token_id, c.centroid_id, list_sum(list_transform(list_zip(f.vec, c.raw), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM fine f, cent c"
_CELLS = """
, cs AS (SELECT unnest([8, 16]) AS kappa_c), ds AS (SELECT unnest([10, 20]) AS kappa_d), als AS (SELECT unnest([NULL, 0.4, 0.5]) AS alpha),
grid AS (SELECT * FROM cs, ds, als),
g AS (SELECT kappa_c, qid, doc_id, sum(sim) AS gs FROM (SELECT kappa_c, qid, qpos, doc_id, max(sim) AS sim FROM ranked JOIN postings USING (centroid_id) JOIN cs ON rank <= kappa_c GROUP BY ALL) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY kappa_c, qid ORDER BY gs DESC, doc_id) AS place, max(gs) OVER (PARTITION BY kappa_c, qid) AS best FROM g),
s AS (SELECT qid, doc_id, round(sum(sim), 9) AS score FROM (SELECT k.qid, k.doc_id, qpos, max(list_dot_product(q.vec, r.vec)) AS sim FROM (SELECT DISTINCT qid, doc_id FROM p WHERE place <= 20) k JOIN qt q USING (qid) JOIN rvec r ON r.doc_id = k.doc_id GROUP BY ALL) GROUP BY ALL),
c AS (SELECT grid.*, p.qid, p.doc_id, s.score FROM p JOIN grid ON p.kappa_c = grid.kappa_c AND place <= kappa_d AND (alpha IS NULL OR best <= 0 OR gs >= alpha * best) JOIN s ON s.qid = p.qid AND s.doc_id = p.doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY kappa_c, kappa_d, alpha, qid ORDER BY score DESC, doc_id) AS rank FROM c),
judged AS (SELECT * FROM qrels WHERE rel >= 2),
cells AS (SELECT * FROM grid, (SELECT DISTINCT qid FROM judged)),
firsts AS (SELECT kappa_c, kappa_d, coalesce(alpha, -1) AS a, t.qid, min(rank) AS r FROM t JOIN judged j ON t.qid = j.qid AND t.doc_id = j.doc_id WHERE rank <= 10 GROUP BY ALL)
SELECT cells.kappa_c, cells.kappa_d, CAST(coalesce(round(alpha * 100), -1) AS INTEGER) AS alpha_x100, count(*) AS n_queries, round(avg(coalesce(1.0 / r, 0)), 6) AS quality
FROM cells LEFT JOIN firsts f ON cells.kappa_c = f.kappa_c AND cells.kappa_d = f.kappa_d AND coalesce(alpha, -1) = a AND cells.qid = f.qid GROUP BY 1, 2, 3
"""


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, unnest({_WORD_LIST}) AS word FROM {table}"


ORACLE_SQL: dict[str, str] = {
    "vec_dot": _sql("SELECT a_id, b_id, round(list_dot_product(a, b), 6) + 0.0 AS dot FROM pairs"),
    "vec_l2sq": _sql("SELECT a_id, b_id, round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0.0 AS l2sq FROM pairs"),
    "vec_cosine": _sql("SELECT a_id, b_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) + 0.0 AS cosine FROM pairs"),
    "vec_normalize": _sql(
        "SELECT vec_id, CAST(d AS INTEGER) AS d, round(CASE WHEN n = 0 THEN x ELSE x / n END, 6) + 0.0 AS x FROM (SELECT vec_id, unnest(range(64)) AS d, unnest(w) AS x, sqrt(list_dot_product(w, w)) AS n FROM (SELECT vec_id, list_transform(v, lambda x: x * (vec_id % 5)) AS w FROM e))"
    ),
    "vec_argmin": _sql("SELECT vec_id, CAST(list_position(v, list_min(v)) - 1 AS INTEGER) AS place FROM e"),
    "vec_argmax": _sql("SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS place FROM e"),
    "l2_batch_nearest": _sql(
        "SELECT b_id AS vec_id, CAST(arg_min(a_id, (dist, a_id)) AS INTEGER) AS nearest, round(min(dist), 6) + 0.0 AS dist FROM (SELECT a_id, b_id, list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM pairs) GROUP BY 1"
    ),
    "token_freq": _sql("SELECT t.token_id, count(fine.token_id) AS n_j FROM (SELECT unnest(range(125)) AS token_id) t LEFT JOIN fine USING (token_id) GROUP BY 1"),
    "token_spread": _sql("SELECT token_id, n_j, round(s_j, 6) + 0.0 AS s_j FROM spread"),
    "vocab_alias_share": _sql("SELECT count(*) AS n_tokens, count(*) FILTER (n >= 2) / count(*) AS share FROM (SELECT token_id, count(*) AS n FROM fine GROUP BY 1)"),
    "token_tier": _sql("SELECT token_id, n_j, tier FROM tiers"),
    "damped_weight": _sql("SELECT token_id, round(sqrt(n_j) * s_j, 6) AS w FROM spread"),
    "ef_rule": _sql("SELECT token_id, count(*) AS k, CAST(count(*) * 3 // 2 AS BIGINT) AS ef FROM fine GROUP BY 1"),
    "budget_tail": _sql("SELECT token_id, n_j, tier, k_tail, left_over FROM left_over"),
    "budget_damped": _sql("SELECT token_id, CAST(k_damped AS BIGINT) AS k_damped, round(CAST(frac AS DOUBLE), 5) AS frac FROM damped"),
    "budget_zero_spread": _sql(
        "SELECT token_id, CAST(CASE WHEN tier = 'active' THEN left_over // n + CASE WHEN r <= left_over % n THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS k_damped FROM (SELECT *, count(*) FILTER (tier = 'active') OVER () AS n, row_number() OVER (PARTITION BY tier ORDER BY token_id) AS r FROM left_over)"
    ),
    "budget_bounded": _sql("SELECT token_id, CAST(k_bounded AS BIGINT) AS k_bounded FROM bounded"),
    "budget_surplus": _sql("SELECT * FROM budgets", kappa="SELECT 60 AS kappa"),
    "budget_deficit": _sql("SELECT * FROM budgets", kappa="SELECT 17 AS kappa"),
    "budget_all": _sql("SELECT * FROM budgets", kappa="SELECT 40 AS kappa"),
    "centroid_offsets": _sql("SELECT token_id, kappa_j, CAST(sum(kappa_j) OVER (ORDER BY token_id) - kappa_j AS BIGINT) AS centroid_lo FROM budgets", kappa="SELECT 40 AS kappa"),
    "centroids_mean": _sql("SELECT centroid_id, token_id, CAST(d AS INTEGER) AS d, round(x, 6) + 0.0 AS x FROM (SELECT centroid_id, token_id, unnest(range(64)) AS d, unnest(raw) AS x FROM cent)"),
    "centroids_unit": _sql("SELECT centroid_id, token_id, CAST(d AS INTEGER) AS d, round(x, 6) + 0.0 AS x FROM (SELECT centroid_id, token_id, unnest(range(64)) AS d, unnest(unit) AS x FROM cent)"),
    "kmeans_degenerate": _sql("SELECT doc_id, pos, token_id, CAST(row_number() OVER (PARTITION BY token_id ORDER BY doc_id, pos) - 1 AS INTEGER) AS local_k FROM fine"),
    "assign_nearest": _sql(f"SELECT doc_id, pos, token_id, CAST(arg_min(centroid_id, (dist, centroid_id)) AS INTEGER) AS centroid_id, round(min(dist), 6) + 0.0 AS dist FROM ({_NEAREST}) GROUP BY 1, 2, 3"),
    "wcss_by_token": _sql("SELECT token_id, round(sum(list_sum(list_transform(list_zip(vec, raw), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) + 0.0 AS wcss FROM ft GROUP BY 1"),
    "wcss_total": _sql(
        f"SELECT (SELECT round(sum(list_sum(list_transform(list_zip(vec, raw), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 5) FROM ft) AS own, (SELECT round(sum(d), 5) FROM (SELECT min(dist) AS d FROM ({_NEAREST}) GROUP BY doc_id, pos)) AS global"
    ),
    "lloyd_one_step": _sql(
        "SELECT centroid_id, CAST(d AS INTEGER) AS d, count(*) AS n, round(avg(x), 6) + 0.0 AS x FROM (SELECT centroid_id, unnest(range(64)) AS d, unnest(vec) AS x FROM (SELECT t.doc_id, t.pos, any_value(t.vec) AS vec, CAST(arg_min(s.pos, (list_sum(list_transform(list_zip(t.vec, s.vec), lambda p: (p[1] - round(p[2], 9)) * (p[1] - round(p[2], 9)))), s.pos)) AS INTEGER) AS centroid_id FROM tok t, tok s WHERE s.doc_id = 0 AND s.pos < 8 GROUP BY 1, 2)) GROUP BY 1, 2"
    ),
    "residual_norms": _sql("SELECT doc_id, pos, centroid_id, round(residual_norm, 6) + 0.0 AS residual_norm FROM norms"),
    "postings": _sql("SELECT * FROM postings"),
    "posting_lengths": _sql("SELECT centroid_id, count(*) AS n_docs FROM postings GROUP BY 1"),
    "posting_lookup": _sql("SELECT centroid_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM postings WHERE centroid_id IN (0, 7, 124) GROUP BY 1"),
    "pq_codebook_degenerate": _sql("SELECT m, code, d, round(x, 6) + 0.0 AS x FROM book"),
    "pq_encode": _sql("SELECT doc_id, pos, m, code FROM codes"),
    "pq_decode": _sql("SELECT doc_id, pos, d, round(x, 6) + 0.0 AS x FROM decoded"),
    "pq_distance_table": _sql("SELECT qid, qpos, m, code, round(vec[m * 2 + 1] * c0 + vec[m * 2 + 2] * c1, 6) + 0.0 AS ip FROM qt, book2"),
    "pq_recon_error": _sql("SELECT centroid_id, round(avg((u - x) * (u - x)), 6) + 0.0 AS mse FROM units JOIN decoded USING (doc_id, pos, d) GROUP BY 1"),
    "reconstruct_tokens": _sql("SELECT doc_id, pos, d, round(x, 6) + 0.0 AS x FROM recon"),
    "index_roundtrip": _sql(f"{_RANKS} found"),
    "search_summary": _sql("SELECT qid, n_tokens, n_hits, round(best, 6) + 0.0 AS best FROM (SELECT qid, count(*) AS n_tokens FROM qt GROUP BY 1) JOIN (SELECT qid, count(*) AS n_hits, max(round(score, 6)) AS best FROM found GROUP BY 1) USING (qid) UNION ALL SELECT 0, 0, 0, NULL"),
    "index_lookup": _sql("SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(CAST(centroid_id AS VARCHAR), ',' ORDER BY pos) AS centroids FROM ft WHERE doc_id % 50 = 0 GROUP BY 1 UNION ALL SELECT -1, 0, NULL"),
    "cluster_invariants": _sql(
        "SELECT token_id, kappa_j AS n_centroids, n_j AS n_assigned, CAST(0 AS BIGINT) AS n_outside, round(bound, 6) + 0.0 AS bound, CAST(1 AS INTEGER) AS within FROM budgets JOIN (SELECT token_id, n_j, n_j * s_j AS bound FROM (SELECT token_id, max(n) AS n_j, sum(s) AS s_j FROM (SELECT token_id, d, count(*) AS n, var_pop(x) AS s FROM (SELECT token_id, unnest(vec) AS x, unnest(range(64)) AS d FROM tok) GROUP BY 1, 2) GROUP BY 1)) USING (token_id)",
        kappa="SELECT 40 AS kappa",
    ),
    "pq_quality": _sql("SELECT CAST(d // 2 AS INTEGER) AS m, count(*) AS n, round(avg((u - x) * (u - x)), 6) + 0.0 AS plain, CAST(1 AS INTEGER) AS within FROM units JOIN decoded USING (doc_id, pos, d) GROUP BY 1"),
    "seeded_sample": """
WITH k AS (SELECT lang, doc_id, -ln((CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / length(text) AS key FROM documents WHERE length(text) > 0)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY key, doc_id) AS INTEGER) AS "order", doc_id, round(key, 9) + 0.0 AS sample_key FROM k QUALIFY "order" <= 5
""",
    "encoder_parity": f"""
WITH w AS ({_words('documents', 'doc_id')}), n AS (SELECT count(*) AS tokens, count(DISTINCT substr(md5(word), 1, 8)) AS ids FROM w), q AS (SELECT count(DISTINCT item_id) AS asked FROM ({_words('benchmark', 'item_id')}))
SELECT gate, CASE gate WHEN 'centroids' THEN ids WHEN 'ranking' THEN asked ELSE tokens END AS n, CAST(1 AS INTEGER) AS ok FROM n, q, (SELECT unnest(['ids', 'vectors', 'runs', 'centroids', 'ranking']) AS gate)
""",
    "encode_marked": _sql(
        "SELECT doc_id, CAST(len(m) AS INTEGER) AS n, md5(array_to_string(m, ' ')) AS md5 FROM (SELECT doc_id, CASE WHEN len(ws) = 0 THEN ws ELSE list_concat(list_concat(ws[1:1], ['[D]']), ws[2:31]) END AS m FROM (SELECT doc_id, coalesce(ws, []) AS ws FROM docwords))"
    ),
    "dump_metadata": _sql("SELECT CAST(2 AS INTEGER) AS format_version, 'docs' AS mode, 'given' AS encoder, CAST(64 AS INTEGER) AS encoder_dim, max(doc_id) + 1 AS n_docs, count(*) AS n_tokens, CAST(0 AS BIGINT) AS dropped FROM tok"),
    "qids_sidecar": _sql("SELECT row_number() OVER (ORDER BY qid) - 1 AS ordinal, qid * 7 AS qid FROM (SELECT DISTINCT qid FROM qt)"),
    "centroid_topk_parts": _sql("SELECT qid, qpos, centroid_id, round(sim, 6) + 0.0 AS sim, rank FROM ranked WHERE rank <= 16"),
    "centroid_topk": _sql("SELECT qid, qpos, centroid_id, round(sim, 6) + 0.0 AS sim, rank FROM ranked WHERE rank <= 16"),
    "gather_scores": _sql("SELECT qid, doc_id, round(raw_score, 6) + 0.0 AS score FROM gathered"),
    "gather_in_jvm": _sql("SELECT qid, doc_id, round(raw_score, 6) + 0.0 AS score FROM gathered"),
    "gather_all_centroids": _sql("SELECT qid, doc_id, round(raw_score, 6) + 0.0 AS score FROM gathered", depth="SELECT 125 AS kappa_c"),
    "prune_topk": _sql(f"{_RANKS} pruned"),
    "prune_alpha": _sql(f"{_RANKS} pruned WHERE top <= 0 OR score >= 0.4 * top"),
    "prune_alpha_guard": _sql(f"{_RANKS} pruned WHERE top <= 0 OR score >= 0.4 * top", scores="SELECT qid, doc_id, -abs(round(raw_score, 9)) AS score FROM gathered"),
    "refine_scores": _sql("SELECT qid, doc_id, round(score, 6) + 0.0 AS score FROM refined"),
    "search_topk": _sql(f"{_RANKS} found"),
    "search_by_graph": _sql(f"{_RANKS} found"),
    "search_topk_alpha": _sql(f"{_RANKS} found", kept="SELECT * FROM pruned WHERE top <= 0 OR score >= 0.4 * top"),
    "maxsim_bruteforce": _sql(f"{_RANKS} exact_top"),
    "topk_overlap": _sql("SELECT x.qid, round(count(p.doc_id) / 10, 6) AS overlap FROM exact_top x LEFT JOIN pruned p ON x.qid = p.qid AND x.doc_id = p.doc_id AND p.rank <= 10 GROUP BY 1"),
    "mrr_at_10": _sql(
        "SELECT count(*) AS n_queries, round(avg(coalesce(1.0 / r, 0)), 6) AS quality FROM (SELECT DISTINCT qid FROM qrels) LEFT JOIN (SELECT p.qid, min(rank) AS r FROM pruned p JOIN qrels j ON p.qid = j.qid AND p.doc_id = j.doc_id WHERE rank <= 10 GROUP BY 1) USING (qid)"
    ),
    "success_at_5": _sql(
        "SELECT count(*) AS n_queries, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS quality FROM (SELECT DISTINCT qid FROM qrels WHERE rel >= 2) LEFT JOIN (SELECT p.qid, min(rank) AS r FROM pruned p JOIN qrels j ON p.qid = j.qid AND p.doc_id = j.doc_id WHERE rank <= 5 AND rel >= 2 GROUP BY 1) USING (qid)"
    ),
    "eval_skipped": _sql("SELECT count(*) FILTER (qid % 3 = 0) AS skipped_no_qrels, count(*) FILTER (qid % 3 <> 0) AS n_queries FROM (SELECT DISTINCT qid FROM qt)"),
    "qrels_lenient": _sql("SELECT * FROM lenient WHERE error IS NOT NULL OR NOT coalesce(rel < 1, false)"),
    "qrels_strict": _sql(
        "SELECT * FROM (SELECT qid, doc_id, rel, CASE WHEN n <> 4 THEN 'columns' WHEN rel IS NULL THEN 'relevance' WHEN qid IS NULL OR doc_id IS NULL THEN 'id' END AS error FROM typed) WHERE error IS NOT NULL OR NOT coalesce(rel < 2, false)"
    ),
    "qrels_duplicates": _sql("SELECT qid, doc_id, count(*) AS n FROM lenient WHERE error IS NULL AND rel >= 1 GROUP BY 1, 2 HAVING count(*) > 1"),
    "latency_report": """
WITH t AS (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS x FROM events WHERE value IS NOT NULL),
l AS (SELECT event_type, list(x ORDER BY x) AS a, count(*) AS n, avg(x) AS m FROM t GROUP BY 1)
SELECT event_type, n, round(m, 4) AS avg, a[least(n * 1 // 100, n - 1) + 1] AS p1, a[least(n * 50 // 100, n - 1) + 1] AS p50, a[least(n * 95 // 100, n - 1) + 1] AS p95, a[least(n * 99 // 100, n - 1) + 1] AS p99, a[1] AS min, a[n] AS max FROM l
""",
    "sweep_grid": _sql("SELECT 1 FROM ranked, postings, qt, rvec, qrels").removesuffix("SELECT 1 FROM ranked, postings, qt, rvec, qrels") + _CELLS,
    "qid_fallback": _sql("SELECT qid - 1 AS ordinal, CASE WHEN qid - 1 < 5 THEN (qid - 1) * 100 + 100 ELSE qid END AS qid FROM (SELECT DISTINCT qid FROM qt)"),
    "doc_id_map": "SELECT row_number() OVER (ORDER BY ext_id) - 1 AS number, ext_id FROM (SELECT DISTINCT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS ext_id FROM documents)",
    "token_validate": _sql(
        "SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(64 AS INTEGER) AS dim_min, CAST(64 AS INTEGER) AS dim_max, CAST(0 AS BIGINT) AS n_not_finite, CAST(0 AS BIGINT) AS n_bad_ids, count(*) FILTER (hi <> n - 1) AS n_broken_docs FROM (SELECT doc_id, count(*) AS n, max(pos) AS hi FROM tok WHERE doc_id <> 3 OR pos <> 4 GROUP BY 1)"
    ),
    "jsonl_docs": "SELECT CAST(doc_id AS VARCHAR) AS ext_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS md5 FROM documents",
    "encode_hash_docs": f"""
WITH w AS ({_words('documents', 'doc_id')}),
c AS (SELECT doc_id, word, list_transform(range(4), lambda i: CAST(('0x' || substr(md5(word || '#' || CAST(i AS VARCHAR)), 1, 4)) AS BIGINT) / 32767.5 - 1) AS v FROM w),
u AS (SELECT doc_id, word, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c)
SELECT doc_id, count(*) AS n_tokens, CAST(sum(CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT)) AS BIGINT) AS ids, CAST(sum(list_sum(list_transform(range(1, 5), lambda i: i * CAST(round(v[i] * 1000000) AS BIGINT)))) AS BIGINT) AS millionths FROM u GROUP BY 1
""",
    "encode_keep_mask": rf"""SELECT item_id, CAST(len({_WORD_LIST}) AS BIGINT) AS kept, CAST(len({_WORD_LIST}) + list_sum(list_transform({_TOKENS}, lambda w: length(regexp_extract(w, '[.,!?;:-]+$')))) AS BIGINT) AS "all" FROM benchmark""",
    "drop_rate": f"SELECT count(*) AS n, count(*) - count(DISTINCT CASE WHEN w.doc_id IS NOT NULL THEN d.doc_id END) AS n_dropped FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM ({_words('documents', 'doc_id')})) w USING (doc_id)",
    "text_search": f"""
WITH h AS (SELECT DISTINCT doc_id, substr(md5(word), 1, 8) AS id FROM ({_words('documents', 'doc_id')})), q AS (SELECT DISTINCT item_id AS qid, substr(md5(word), 1, 8) AS id FROM ({_words('benchmark', 'item_id')})),
s AS (SELECT qid, doc_id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN h USING (id) GROUP BY 1, 2)
SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s) WHERE rank <= 10
""",
    "token_dump_roundtrip": _sql("SELECT doc_id, pos, token_id, CAST(d AS INTEGER) AS d, round(x, 6) + 0.0 AS x FROM (SELECT doc_id, pos, token_id, unnest(range(64)) AS d, unnest(vec) AS x FROM tok)"),
}

# The cells of a sweep, of which the timed one has some.
ORACLE_SQL["sweep_csv"] = (
    "SELECT 'given' AS dataset, CAST(kappa_c AS VARCHAR) AS kappa_c, CAST(kappa_d AS VARCHAR) AS kappa_d, CAST(alpha_x100 AS VARCHAR) AS alpha_x100, CAST(n_queries AS VARCHAR) AS n_queries, quality, CAST(7 AS INTEGER) AS n_timed, 'none' AS git_sha FROM ("
    + ORACLE_SQL["sweep_grid"]
    + ") WHERE kappa_d = 20 AND alpha_x100 IN (-1, 40)"
)
