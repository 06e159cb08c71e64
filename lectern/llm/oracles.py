"""DuckDB statements that give the same rows as the queries, for the operators that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .quality_rules import ERROR, GRIDS, RISK

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t),
 e AS (SELECT n.doc_id, keep_id, group_size, t, row_number() OVER (PARTITION BY t, doc_id) AS copy FROM n JOIN g USING (t))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(t) AS text_sha256 FROM e
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
 win AS (SELECT r, doc_id, p, list_aggregate(w[p : p + 12], 'string_agg', ' ') AS g
   FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE doc_id IS NOT NULL)),
 first AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
 gone AS (SELECT r, list(DISTINCT q) AS qs FROM (SELECT r, unnest(range(p, p + 13)) AS q FROM win JOIN first USING (g) WHERE least < doc_id) GROUP BY r),
 kept AS (SELECT doc_id, w, CASE WHEN qs IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
 sha256(coalesce(list_aggregate(k, 'string_agg', ' '), '')) AS kept_sha256 FROM kept
"""

OP7 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
 c AS (SELECT *, length(bin(size + 1)) * 8 + ((size + 1) * 8) // (CAST(1 AS BIGINT) << CAST(length(bin(size + 1)) - 1 AS BIGINT)) - 8 AS cls FROM d),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, 2 * source_size AS most, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
 r AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM w),
 l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
 one AS (SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1) AS level),
 t AS (SELECT source, source_size, CASE WHEN one.level IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), weight * one.level) END AS target FROM l, one),
 e AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate,
   row_number() OVER (PARTITION BY c.source ORDER BY cls, k, doc_id NULLS FIRST) AS n,
   CAST('0x' || substr(md5('mix' || CASE WHEN c.source IS NULL THEN 'n' ELSE 's' END || coalesce(c.source, '')), 1, 8) AS BIGINT) / 4294967296e0 AS u
   FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(n * rate + u) - floor((n - 1) * rate + u) AS BIGINT) * size AS taken FROM e
"""

_tests = len(GRIDS) and sum(map(len, GRIDS.values()))
_risk = RISK / len(GRIDS)
_tried = ", ".join(f"('{m}', CAST({c} AS DOUBLE))" for m, cs in GRIDS.items() for c in cs)
_value = "CASE measure " + " ".join(f"WHEN '{m}' THEN {m}" for m in GRIDS) + " END"

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS stratum, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
 tri AS (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d))),
 rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE n > 1) GROUP BY r),
 li AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 m AS (SELECT r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(coalesce(list_aggregate(w, 'string_agg', ''), '')) AS BIGINT) AS word_chars,
   CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
   CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN li USING (r) LEFT JOIN rep USING (r)),
 s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
   CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0e0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0e0 END AS dup_line_share,
   CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0e0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0e0 END AS word_length FROM m),
 lab AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
 tried(measure, cutoff) AS (VALUES {_tried}),
 cnt AS (SELECT stratum, measure, cutoff, count(*) AS n, count(*) FILTER ({_value} > cutoff) AS k
   FROM s JOIN lab USING (doc_id), tried WHERE good AND NOT base_failed GROUP BY ALL),
 ok AS (SELECT stratum, measure, min(cutoff) AS cut FROM cnt WHERE k < n * {_risk}e0 AND
   list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_risk}e0) + (n - i) * ln(1 - {_risk}e0))))
   <= {ERROR}e0 / ((SELECT count(DISTINCT stratum) FROM s) * {_tests}) GROUP BY stratum, measure),
 v AS (SELECT s.*, [x[1] FOR x IN [{", ".join(f"('{m}', {m} > (SELECT cut FROM ok WHERE ok.stratum = s.stratum AND ok.measure = '{m}'))" for m in GRIDS)}] IF x[2]] AS reasons FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(reasons) = 0 AS kept,
 coalesce(list_aggregate(reasons, 'string_agg', ','), '') AS reasons FROM v
"""

# CRC-32 of the decimal id: each byte, then eight shifts (-1) by the reversed polynomial
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
   lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

OP11 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w, CASE WHEN doc_id IS NOT NULL THEN {_CRC} END AS h FROM documents),
 s AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
 a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM s),
 p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
 t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(0, n)] END AS w FROM p),
 chain AS MATERIALIZED (SELECT DISTINCT r, q FROM (SELECT r, w, q, unnest(range(0, (n - 1) // q - 2)) AS j FROM (SELECT r, n, w, unnest(range(1, n // 4 + 1)) AS q FROM t WHERE n >= 6))
   WHERE w[j * q + 1] = w[(j + 1) * q + 1] AND w[j * q + 1] = w[(j + 2) * q + 1] AND w[j * q + 1] = w[(j + 3) * q + 1]),
 eq AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island
   FROM (SELECT r, q, w, unnest(range(1, n - q + 1)) AS i FROM chain JOIN t USING (r)) WHERE w[i] = w[i + q]),
 stretch AS (SELECT r, q, min(i) - 1 AS start, count(*) + q AS length FROM eq GROUP BY r, q, island),
 run AS (SELECT r, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
 sums AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY r),
 best AS (SELECT DISTINCT ON (r) r, start, length, period FROM run ORDER BY r, CAST(length AS DOUBLE) / period DESC, start, period),
 gone AS (SELECT r, list(DISTINCT i) AS gs FROM (SELECT r, unnest(range(start + period + 1, start + length + 1)) AS i FROM run) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
 sha256(coalesce(list_aggregate(CASE WHEN gs IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gs, i)) END, 'string_agg', ' '), '')) AS collapsed_sha256
FROM t LEFT JOIN sums USING (r) LEFT JOIN best USING (r) LEFT JOIN gone USING (r)
"""


def _whole(scale: int) -> str:
    fine = "embedding IS NOT NULL AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]) IS DISTINCT FROM false"
    return f"(SELECT row_number() OVER () AS r, vec_id, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE {fine})"


OP12 = f"""
WITH e AS MATERIALIZED {_whole(256)},
 s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
   FROM e AS q JOIN e AS c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""


def _lloyd(rounds: int = 10, k: int = 8, size: int = 64) -> str:
    steps = [f"""WITH e AS MATERIALIZED (SELECT r, vec_id, [CAST(x AS BIGINT) FOR x IN v] AS v FROM {_whole(1024)} WHERE len(v) = {size}),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM e QUALIFY j < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d
   FROM (SELECT r, j, CAST(list_sum([(v[x] - c[x]) * (v[x] - c[x]) FOR x IN range(1, {size + 1})]) AS BIGINT) AS d FROM e CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT j, list(m ORDER BY x) AS c FROM (SELECT j, x, CAST((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
   FROM (SELECT j, unnest(range(1, {size + 1})) AS x, unnest(v) AS y FROM e JOIN a{i} USING (r)) GROUP BY j, x) GROUP BY j),
 c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} AS m USING (j))""")
    return ",\n ".join(steps) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} JOIN e USING (r) JOIN c{rounds} USING (j)
"""


OP13 = _lloyd()

ORACLES = {
    "op1_exact_dedup": OP1, "op6_substring_dedup": OP6, "op7_mixing": OP7, "op10_quality_rules": OP10,
    "op11_periodic_runs": OP11, "op12_topk_search": OP12, "op13_centroid_clustering": OP13,
}
