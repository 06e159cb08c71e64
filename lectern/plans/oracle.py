"""DuckDB statements of the registered queries. The adapter views are inlined; regular expressions use ``\\b``, which is ASCII
there."""

from __future__ import annotations

from ..fixtures import ctes
from ..functions import text as t
from ..operators.export import FAN
from ..operators.quality import BANNED, DANGLING
from ..operators.reports import BUCKETS
from ..schemas import FAILURE_MODES, thresholds
from .catalogue import CHOICES, CHUNK_MOST, CHUNK_TARGET, COMPETENCIES, GATE, GPU_HIGH, GPU_LOW, JUDGES, RAW_SCORES, REQUESTS, RESULTS, STORED_QUIZZES, TEXTS, TITLES, TOP_K, UNITS

ORACLES: dict[str, str] = {}


def sql(name: str, body: str, *views: str, more: str = "") -> None:
    head = ctes(*views) + (",\n" + more if more else "") if views else ("WITH RECURSIVE " + more if more else "")
    ORACLES[name] = f"{head}\n{body}"


def _count(column: str, words: str, flags: str = "") -> str:
    return rf"len(regexp_extract_all({column}, '{flags}\b(?:{words})\b'))"


USABLE = """rich AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY document_id, page_number) AS seen FROM fx_page WHERE length(text) >= 40),
 usable AS (SELECT * FROM rich WHERE seen = 1)"""
LANGUAGE = f"""low AS (SELECT document_id, lower(text) AS x, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS n FROM usable),
 lang AS (SELECT document_id, CAST(sum({_count("x", "|".join(t.GERMAN_MARKERS))}) AS BIGINT) AS german, CAST(sum({_count("x", "|".join(t.ENGLISH_MARKERS))}) AS BIGINT) AS english FROM low WHERE n <= 5 GROUP BY 1)"""
OF_LANGUAGE = "CASE WHEN german = 0 AND english = 0 THEN 'unknown' WHEN german > english THEN 'de' ELSE 'en' END"

sql("doc_extraction_report", f"""
SELECT document_id, 'OTHER' AS role, coalesce(s.pages, 0) AS pages, e.poor AS text_poor_pages, coalesce(s.chars, 0) AS chars, CAST(ceil(coalesce(s.chars, 0) / 2.38e0) AS BIGINT) AS approx_tokens,
 coalesce(s.damaged, 0) AS damaged_tokens, coalesce(s.alt, 0) AS alt_text_lines, {OF_LANGUAGE.replace("german", "coalesce(german, 0)").replace("english", "coalesce(english, 0)")} AS language
FROM (SELECT document_id, CAST(count(*) FILTER (length(text) < 40) AS BIGINT) AS poor FROM fx_page GROUP BY 1) e
LEFT JOIN (SELECT document_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({_count("text", "|".join(t.LIGATURE_DAMAGE))}) AS BIGINT) AS damaged,
 CAST(sum({_count("text", "|".join(t.ALT_TEXT), "(?i)")}) AS BIGINT) AS alt FROM usable GROUP BY 1) s USING (document_id) LEFT JOIN lang USING (document_id)""", "fx_page", more=f"{USABLE}, {LANGUAGE}")  # fmt: skip
sql("doc_language_detect", f"SELECT document_id, german, english, {OF_LANGUAGE} AS language FROM lang", "fx_page", more=f"{USABLE}, {LANGUAGE}")

CHUNKED = f"""{USABLE},
 k AS (SELECT *, CAST(ceil(length(text) / 2.38e0) AS BIGINT) AS tok, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS rn FROM usable),
 r(document_id, rn, mine, chunk, held, waiting) AS (
  SELECT document_id, rn, 0, CASE WHEN tok >= {CHUNK_TARGET} THEN 1 ELSE 0 END, CASE WHEN tok >= {CHUNK_TARGET} THEN 0 ELSE tok END, CASE WHEN tok >= {CHUNK_TARGET} THEN 0 ELSE 1 END FROM k WHERE rn = 1
  UNION ALL
  SELECT document_id, rn, mine, CASE WHEN full_ THEN mine + 1 ELSE mine END, CASE WHEN full_ THEN 0 ELSE held + tok END, CASE WHEN full_ THEN 0 ELSE waiting + 1 END FROM (
   SELECT k.document_id, k.rn, k.tok, r.held, r.waiting, CASE WHEN k.tok >= {CHUNK_MOST} AND r.waiting > 0 THEN r.chunk + 1 ELSE r.chunk END AS mine, k.tok >= {CHUNK_MOST} OR r.held + k.tok >= {CHUNK_TARGET} AS full_
   FROM r JOIN k ON k.document_id = r.document_id AND k.rn = r.rn + 1) x),
 ch AS (SELECT document_id, mine, min(lecture) AS lecture, min(page_number) AS first_page, max(page_number) AS last_page, sum(length(text)) + 2 * (count(*) - 1) AS n_chars FROM r JOIN k USING (document_id, rn) GROUP BY 1, 2)"""
sql("page_chunks", "SELECT document_id || '#p' || first_page || '-' || last_page AS chunk_id, document_id, CAST(first_page AS BIGINT) AS first_page, CAST(last_page AS BIGINT) AS last_page, CAST(n_chars AS BIGINT) AS n_chars FROM ch", "fx_page", more=CHUNKED)
QUERY = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '^[0-9]+\s+', ''), '_{{2,}}', ' ', 'g'), '\s{{2,}}', ' ', 'g'))"
sql("topic_catalogue", f"SELECT lecture AS topic, {QUERY.format('lecture')} AS query, count(*) AS chunks, row_number() OVER (ORDER BY min((document_id, first_page)), lecture) AS position FROM ch GROUP BY lecture", "fx_page", more=CHUNKED)

TOP = f"""v AS (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM fx_chunk),
 n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
 sc AS (SELECT q.chunk_ord AS query_id, c.chunk_ord, c.chunk_id, c.role, CASE WHEN q.norm = 0 OR c.norm = 0 THEN 0e0 ELSE list_dot_product(q.e, c.e) / (q.norm * c.norm) END AS score FROM n q, n c WHERE q.chunk_ord % 50 = 0),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ord) AS rank FROM sc) x WHERE rank <= {TOP_K})"""
sql("cosine_topk", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM top", "fx_chunk", more=TOP)


def _decide(threshold: float, gate: tuple = ()) -> str:
    worst = "max(severity)" + (f" FILTER (mode IN {gate})" if gate else "")
    return f"SELECT item_id, 1 - coalesce({worst}, 0) AS aggregate_score, CAST(sum(CAST(severity AS DECIMAL(18, 12))) AS DOUBLE) / count(severity) AS mean_severity, 1 - coalesce({worst}, 0) >= {threshold}e0 AS accepted FROM fx_severity GROUP BY item_id"


DECIDED = f"d AS ({_decide(0.7)}), items AS (SELECT i.*, d.accepted FROM fx_item i LEFT JOIN d USING (item_id))"
REGISTERED = "run_id IN (SELECT run_id FROM fx_run)"
ENDED = "state IN ('FILTERED', 'FAILED_GENERATION', 'FAILED_FILTER')"
sql("gate_decisions", f"SELECT item_id, round(aggregate_score, 6) AS aggregate_score, round(mean_severity, 6) AS mean_severity, accepted FROM ({_decide(0.7, GATE)})", "fx_severity")
sql("verdict_normalise", """
SELECT item_id, mode, round(severity, 6) AS severity, triggered FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM (
 SELECT item_id, upper(translate(trim(mode), ' -', '__')) AS mode, arg_max(greatest(0e0, least(1e0, coalesce(severity, 0e0))), ord) AS severity, arg_max(coalesce(triggered, false), ord) AS triggered
 FROM raw WHERE upper(translate(trim(mode), ' -', '__')) IN ('FACTUAL_ERROR', 'AMBIGUOUS_CORRECT_ANSWER', 'OFF_TOPIC', 'NEAR_DUPLICATE', 'ILL_FORMED_DISTRACTORS') GROUP BY 1, 2)) WHERE n = 5""", more=f"raw AS ({RAW_SCORES})")  # fmt: skip
sql("redecide_changes", f"""
SELECT count(*) AS total, CAST(count(*) FILTER (n.accepted <> o.accepted OR n.aggregate_score <> o.aggregate_score) AS BIGINT) AS changed, CAST(count(*) FILTER (n.accepted) AS BIGINT) AS accepted
FROM ({_decide(0.6, GATE)}) n JOIN ({_decide(0.8)}) o USING (item_id) JOIN fx_item i USING (item_id) WHERE i.state = 'FILTERED' AND i.{REGISTERED}""", "fx_severity", "fx_item", "fx_run")  # fmt: skip
sql("incremental_enqueue", """
SELECT cell_key, coalesce(n, 0) AS existing, CAST(coalesce(n, 0) + more AS BIGINT) AS target, CASE WHEN more > 0 THEN coalesce(n, 0) END AS first_index, CAST(more AS BIGINT) AS new_items FROM (
 SELECT c.cell_key, e.n, CASE WHEN e.n IS NULL OR c.competency_key IN (SELECT competency_key FROM hit) THEN 20 ELSE 0 END AS more
 FROM (SELECT DISTINCT competency_key, concat_ws('|', competency_key, language, difficulty_band) AS cell_key FROM fx_item) c
 LEFT JOIN (SELECT concat_ws('|', competency_key, language, difficulty_band) AS cell_key, count(*) AS n FROM fx_item WHERE run_id = 'run-1' AND state = 'PENDING' AND competency_key <> 'c3' GROUP BY 1) e USING (cell_key))""", "fx_item", more="""
 dd AS (SELECT doc_id, source || '/doc' || doc_id AS document, sha256(text) AS h FROM documents),
 was AS (SELECT document, CASE WHEN doc_id % 97 = 1 THEN 'x' ELSE h END AS h FROM dd WHERE doc_id % 97 <> 0),
 changed AS (SELECT dd.document FROM dd LEFT JOIN was USING (document) WHERE was.h IS DISTINCT FROM dd.h),
 hit AS (SELECT DISTINCT 'c' || (doc_id % 97 % 16) AS competency_key FROM dd JOIN changed c ON starts_with(dd.document || '.pdf#p1-2', c.document))""")  # fmt: skip
sql("pool_grid", """
SELECT row_number() OVER (ORDER BY o1, o2, o3, o4) AS position, concat_ws('|', course_key, competency_key, l, q, d) AS cell_key, q AS question_type FROM
 (SELECT s_suppkey AS o1, 'n' || s_nationkey AS course_key, 'c' || s_suppkey AS competency_key FROM supplier) r, (VALUES (0, 'de'), (1, 'en')) a(o2, l),
 (VALUES (0, 'single-choice'), (1, 'multiple-choice'), (2, 'true-false')) b(o3, q), (VALUES (0, 'easy'), (1, 'medium'), (2, 'hard')) c(o4, d)""")
sql("items_missing_verdict", """
SELECT item_id, competency_key, state FROM fx_item i WHERE configuration_id = 'pool|local' AND state IN ('GENERATED', 'FILTERING', 'FILTERED')
 AND NOT EXISTS (SELECT 1 FROM fx_verdict v WHERE v.item_id = i.item_id AND judge_model = 'judge-cloud' AND scope = 'GENERAL')""", "fx_item", "fx_verdict")  # fmt: skip
sql("pool_candidates_asof", """
SELECT i.item_id, difficulty_band, state FROM fx_item i JOIN fx_verdict v USING (item_id) WHERE competency_key = 'c2' AND language = 'en' AND updated_at <= TIMESTAMP '1996-06-30 00:00:00'
 AND judge_model = 'judge-local' AND scope = 'GENERAL' AND accepted""", "fx_item", "fx_verdict")  # fmt: skip
sql("pool_judge_matrix", """
SELECT item_id, bool_or(accepted) FILTER (judge_model = 'judge-local') AS judge_local, bool_or(accepted) FILTER (judge_model = 'judge-cloud') AS judge_cloud
FROM fx_item LEFT JOIN fx_verdict USING (item_id) WHERE configuration_id = 'pool|local' GROUP BY item_id""", "fx_item", "fx_verdict")  # fmt: skip
sql("browse_items", """
SELECT item_id, competency_key, (SELECT count(*) FROM fx_call c WHERE c.item_id = x.item_id) AS attempts FROM
 (SELECT * FROM items WHERE state = 'FILTERED' AND run_id = 'run-2' AND accepted ORDER BY updated_at DESC, item_id LIMIT 100) x""", "fx_item", "fx_severity", "fx_call", more=DECIDED)  # fmt: skip
sql("state_progress", """
SELECT *, (done + failed) * 100 // total AS percent FROM (SELECT run_id, count(*) AS total, CAST(count(*) FILTER (state = 'FILTERED') AS BIGINT) AS done, CAST(count(*) FILTER (state IN ('GENERATED', 'FILTERING')) AS BIGINT) AS awaiting_judge,
 CAST(count(*) FILTER (state IN ('PENDING', 'GENERATING')) AS BIGINT) AS to_generate, CAST(count(*) FILTER (state IN ('FAILED_GENERATION', 'FAILED_FILTER')) AS BIGINT) AS failed,
 count(*) FILTER (state IN ('PENDING', 'GENERATING', 'GENERATED', 'FILTERING')) = 0 AS complete FROM fx_item GROUP BY run_id)""", "fx_item")  # fmt: skip
sql("state_counts", "SELECT run_id, state, count(*) AS n FROM fx_item GROUP BY 1, 2", "fx_item")
sql("quizzes_by_approach", r"SELECT run_id, configuration_id, count(*) AS quizzes FROM fx_item WHERE configuration_id LIKE 'two-phase|%' ESCAPE '\' GROUP BY 1, 2", "fx_item")
sql("quiz_run_recency", "SELECT row_number() OVER (ORDER BY max(updated_at) DESC, run_id) AS position, run_id, count(*) AS quizzes FROM fx_item GROUP BY run_id", "fx_item")

STORED = f"st AS ({STORED_QUIZZES})"
sql("sweep_worklist", """
SELECT configuration_id, request_key, CAST(repetition AS BIGINT) AS repetition FROM fx_configuration, fx_request, (VALUES (1), (2), (3)) r(repetition)
WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.configuration_id = fx_configuration.configuration_id AND st.request_key = fx_request.request_key AND st.repetition = r.repetition AND (st.questions > 0 OR st.bad = 0))""", "fx_call", "fx_configuration", "fx_request", more=STORED)  # fmt: skip
sql("sweep_status", "SELECT c.configuration_id, count(st.request_key) AS quizzes FROM (SELECT configuration_id FROM fx_configuration UNION ALL SELECT 'agentic|cloud|cloud|cloud') c LEFT JOIN st USING (configuration_id) GROUP BY 1", "fx_call", "fx_configuration", more=STORED)

MCQ = r"""m AS (SELECT *, list_filter([opt1, opt2, opt3, opt4], lambda x: x IS NOT NULL) AS texts, CASE WHEN opt4 IS NULL THEN [c1, c2, c3] ELSE [c1, c2, c3, c4] END AS cs FROM fx_mcq),
 m2 AS (SELECT *, list_transform(texts, lambda x: trim(regexp_replace(regexp_replace(lower(x), '\s+', ' ', 'g'), '[.,;:]+$', ''))) AS ns, len(list_filter(cs, lambda c: c)) AS right_,
  coalesce(list_max([length(trim(texts[i])) FOR i IN range(1, len(texts) + 1) IF cs[i]]), 0) AS r, coalesce(list_max([length(trim(texts[i])) FOR i IN range(1, len(texts) + 1) IF NOT cs[i]]), 0) AS w,
  CASE WHEN type = 'true-false' THEN 2 ELSE 4 END AS need FROM m),
 m3 AS (SELECT item_id, bool_or(length(a) < length(b) AND regexp_matches(b, '\b' || regexp_escape(a) || '\b')) AS contained FROM (SELECT item_id, unnest(ns) AS a, ns FROM m2), LATERAL (SELECT unnest(ns) AS b) GROUP BY 1)"""
DEFECT = rf"""CASE WHEN trim(title) = '' OR trim(question_text) = '' THEN 'BLANK_TEXT'
  WHEN regexp_matches(question_text, '(?i)\b{DANGLING}\b') AND NOT contains(question_text, chr(10)) THEN 'DANGLING_REFERENCE'
  WHEN len(texts) <> need THEN 'OPTION_COUNT' WHEN len(list_filter(texts, lambda x: trim(x) = '')) > 0 THEN 'BLANK_OPTION'
  WHEN len(list_distinct(list_transform(texts, lambda x: lower(x)))) <> need THEN 'DUPLICATE_OPTIONS'
  WHEN len(list_filter(texts, lambda x: regexp_matches(x, '(?i)\b(?:{"|".join(BANNED)})\b'))) > 0 THEN 'BANNED_CONSTRUCTION'
  WHEN contained THEN 'CONTAINED_OPTION' WHEN CASE WHEN type = 'multiple-choice' THEN right_ NOT BETWEEN 1 AND 3 ELSE right_ <> 1 END THEN 'CORRECT_COUNT'
  WHEN w > 0 AND r - w >= 20 AND r / w > 1.15e0 THEN 'CONSPICUOUS_LENGTH' END"""
sql("item_defects", f"SELECT item_id, type, {DEFECT} AS defect FROM m2 JOIN m3 USING (item_id)", "fx_mcq", more=MCQ)
sql("defect_histogram", f"SELECT type, defect, count(*) AS n FROM (SELECT type, CASE WHEN type = 'true-false' THEN 'TYPE_NOT_REQUESTED' ELSE {DEFECT} END AS defect FROM m2 JOIN m3 USING (item_id)) WHERE defect IS NOT NULL GROUP BY 1, 2", "fx_mcq", more=MCQ)
sql("item_length_stats", "SELECT item_id, length(title) AS title, length(question_text) AS question_text, CAST(0 AS BIGINT) AS explanation, list_max(list_transform(texts, lambda x: length(x))) AS longest_option FROM m", "fx_mcq", more=MCQ)
sql("call_failure_classes", "SELECT coalesce(failure_category, 'none') AS category, coalesce(failure_category NOT IN ('AUTH', 'BAD_REQUEST'), true) AS retryable, count(*) AS calls FROM fx_call GROUP BY 1, 2", "fx_call")
sql("http_classes", """
SELECT call_id, attempt, s AS status, k AS kind, k NOT IN ('AUTH', 'BAD_REQUEST') AS retryable, CAST(least(30000, 1000 * pow(2, attempt - 1)) AS BIGINT) AS backoff_ms FROM (
 SELECT *, CASE WHEN s IN (401, 403) THEN 'AUTH' WHEN s = 429 THEN 'RATE_LIMIT' WHEN s = 408 THEN 'TIMEOUT' WHEN s >= 500 THEN 'TRANSPORT' WHEN s >= 400 THEN 'BAD_REQUEST' ELSE 'TRANSPORT' END AS k
 FROM (SELECT event_id AS call_id, event_id % 7 + 1 AS attempt, 395 + user_id * 7 % 130 AS s FROM events))""")  # fmt: skip



def _cost(source: str, by: str) -> str:
    return f"""SELECT {by}, prompt_tokens, completion_tokens, billed_ms, unpriced_models, token_eur + billed_ms / 3600000e0 * {GPU_LOW}e0 AS low_eur, token_eur + billed_ms / 3600000e0 * {GPU_HIGH:.1f}e0 AS high_eur, billed_ms = 0 AS exact FROM (
 SELECT {by}, sum(CASE WHEN billing = 'tokens' THEN coalesce(prompt_tokens, 0) / 1e6 * input_eur + coalesce(completion_tokens, 0) / 1e6 * output_eur ELSE 0 END) AS token_eur,
  CAST(sum(CASE WHEN billing = 'tokens' THEN coalesce(prompt_tokens, 0) ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN billing = 'tokens' THEN coalesce(completion_tokens, 0) ELSE 0 END) AS BIGINT) AS completion_tokens,
  CAST(sum(CASE WHEN billing = 'gpu-time' THEN wall_clock_ms ELSE 0 END) AS BIGINT) AS billed_ms, coalesce(string_agg(DISTINCT CASE WHEN billing IS NULL THEN model END, ',' ORDER BY CASE WHEN billing IS NULL THEN model END), '') AS unpriced_models
 FROM {source} LEFT JOIN fx_price USING (model) GROUP BY {by})"""


MONEY = "round(low_eur, 6) AS low_eur, round(high_eur, 6) AS high_eur"
sql("call_costs", f"SELECT * REPLACE (round(low_eur, 6) AS low_eur, round(high_eur, 6) AS high_eur) FROM ({_cost('fx_call', 'stage')})", "fx_call", "fx_price")
sql("cost_per_configuration", f"""
SELECT configuration_id, items, accepted, failed, prompt_tokens, completion_tokens, billed_ms, unpriced_models, {MONEY}, exact, round(low_eur / items, 6) AS per_item_low, round(high_eur / items, 6) AS per_item_high,
 round(low_eur / nullif(accepted, 0), 6) AS per_accepted_low, round(high_eur / nullif(accepted, 0), 6) AS per_accepted_high
FROM (SELECT configuration_id, CAST(count(*) FILTER (state = 'FILTERED') AS BIGINT) AS items, CAST(count(*) FILTER (state = 'FILTERED' AND accepted) AS BIGINT) AS accepted, CAST(count(*) FILTER (state <> 'FILTERED') AS BIGINT) AS failed FROM seen GROUP BY 1)
JOIN ({_cost("(SELECT c.*, s.configuration_id FROM fx_call c JOIN seen s USING (item_id))", "configuration_id")}) USING (configuration_id)""", "fx_item", "fx_severity", "fx_run", "fx_call", "fx_price", more=f"{DECIDED}, seen AS (SELECT * FROM items WHERE {ENDED} AND {REGISTERED})")  # fmt: skip
POOL = f"""pc AS ({_cost(f"(SELECT 'local' AS generator, model, prompt_tokens, completion_tokens, wall_clock_ms FROM fx_call WHERE item_id IN (SELECT item_id FROM fx_item WHERE configuration_id = 'pool|local' AND {ENDED}) UNION ALL SELECT 'local', model, prompt_tokens, completion_tokens, wall_clock_ms FROM fx_call WHERE stage = 'filter')", "generator, model")}),
 qc AS (SELECT *, (low_eur + high_eur) / 2 / quizzes AS mid FROM (SELECT configuration_id, count(*) AS quizzes FROM fx_item WHERE state = 'FILTERED' AND configuration_id <> 'pool|local' GROUP BY 1)
  JOIN ({_cost("(SELECT c.*, i.configuration_id FROM fx_call c JOIN fx_item i USING (item_id) WHERE i.state = 'FILTERED' AND i.configuration_id <> 'pool|local')", "configuration_id")}) USING (configuration_id))"""
sql("pool_costs", "SELECT * REPLACE (round(low_eur, 6) AS low_eur, round(high_eur, 6) AS high_eur) FROM pc", "fx_item", "fx_call", "fx_price", more=POOL)
sql("quiz_costs", "SELECT * EXCLUDE (mid) REPLACE (round(low_eur, 6) AS low_eur, round(high_eur, 6) AS high_eur), round(mid, 6) AS mid_per_quiz FROM qc", "fx_item", "fx_call", "fx_price", more=POOL)
sql("sweep_amortisation", """
SELECT configuration_id, against, round(agentic_mid, 6) AS agentic_mid, round(two_phase_mid, 6) AS two_phase_mid, round(pool_mid, 6) AS pool_mid,
 CAST(CASE WHEN agentic_mid - two_phase_mid <= 0 THEN -1 ELSE ceil(pool_mid / (agentic_mid - two_phase_mid)) END AS BIGINT) AS break_even
FROM (SELECT t.configuration_id, a.configuration_id AS against, qa.mid AS agentic_mid, qt.mid AS two_phase_mid,
  (SELECT coalesce(sum((low_eur + high_eur) / 2), 0) FROM pc WHERE pc.generator = t.generator AND pc.model IN (t.generator_model, t.judge_model)) AS pool_mid
 FROM fx_configuration t, fx_configuration a, qc qt, qc qa WHERE t.approach = 'two-phase' AND a.ord = 0 AND qt.configuration_id = t.configuration_id AND qa.configuration_id = a.configuration_id)""", "fx_item", "fx_call", "fx_price", "fx_configuration", more=POOL)  # fmt: skip
sql("phase_usage", """
SELECT configuration_id, coalesce(stage, 'unknown') AS stage, count(*) AS calls, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens
FROM fx_call JOIN fx_item USING (item_id) WHERE state = 'FILTERED' AND configuration_id <> 'pool|local' GROUP BY 1, 2""", "fx_item", "fx_call")  # fmt: skip
sql("selection_ratio", """
SELECT *, round(CASE WHEN candidates = 0 THEN 0e0 ELSE questions / candidates END, 6) AS selection_ratio FROM (SELECT configuration_id, CAST(sum(item_id % 5) AS BIGINT) AS questions,
 CAST(sum(CASE WHEN configuration_id LIKE 'two%' THEN item_id % 40 ELSE 0 END) AS BIGINT) AS candidates FROM fx_item GROUP BY 1)""", "fx_item")  # fmt: skip
NUMBERED = "quiz_id || '-q' || (row_number() OVER (PARTITION BY quiz_id ORDER BY q_index) - 1)"
sql("public_questions", r"""
SELECT quiz_id, question_id, q.text AS question, CASE r.course_key WHEN 'EIDI' THEN 'java' WHEN 'PSE' THEN 'se' WHEN 'EIST' THEN 'se' ELSE lower(r.course_key) END AS domain, r.language, c.title AS competency,
 coalesce(CASE WHEN c.title IS NULL THEN NULL WHEN coalesce(trim(c.description), '') = '' THEN c.title ELSE c.title || ' — ' ||
  array_to_string(list_transform(list_filter(list_transform(string_split(c.description, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, '- ') THEN substr(x, 3) ELSE x END), ' ') END, r.objectives) AS learning_objective,
 coalesce(c.taxonomy, r.bloom) AS bloom_intended
FROM (SELECT *, """ + NUMBERED + """ AS question_id FROM fx_question) q JOIN req r ON r.request_key = 'r' || (quiz_id % 4 + 1) LEFT JOIN comp c ON c.course_key = r.course_key AND c.competency_key = 'c' || (quiz_id % 5)""", "fx_question", more=f"comp AS ({COMPETENCIES}), req AS ({REQUESTS})")  # fmt: skip
sql("hidden_questions", f"SELECT quiz_id, {NUMBERED} AS question_id, 'ai' AS provenance, 'two-phase|local|cloud|cloud' AS generator_id FROM fx_question", "fx_question")


def _groups(key: str, condition: str, where: str, name: str) -> str:
    names = lambda c: f"array_to_string(list_sort(list(DISTINCT {c})), ',')"
    band = "CASE WHEN requested_difficulty < 30 THEN 'easy' WHEN requested_difficulty <= 70 THEN 'medium' ELSE 'hard' END"
    lecture = "CASE WHEN requested_difficulty > 20 THEN 'lec' || substr(competency_key, 2) END"
    return rf"""SELECT group_key, condition, count(*) AS item_count, {names("configuration_id")} AS configuration_ids, {names("run_id")} AS run_ids, {names("competency_key")} AS topics, CASE WHEN count(DISTINCT {band}) = 1 THEN min({band}) END AS difficulty,
 CASE WHEN count(DISTINCT {lecture}) = 1 THEN min({lecture}) ELSE '.' END AS source_material, regexp_replace(regexp_replace(group_key, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') || '__' || condition AS quiz_id, '{name}' AS granularity
FROM (SELECT *, {key} AS group_key, {condition} AS condition FROM items WHERE state = 'FILTERED' AND {REGISTERED} AND {where}) GROUP BY 1, 2"""


sql("item_export_groups", _groups("configuration_id || '__' || competency_key", "CASE WHEN coalesce(accepted, false) THEN 'accepted' ELSE 'rejected' END", "true", "configuration_topic") + "\nUNION ALL\n"
    + _groups("run_id", "'accepted'", "coalesce(accepted, false)", "run"), "fx_item", "fx_severity", "fx_run", more=DECIDED)
STEPS = ", ".join(f"({i}, {x!r}e0)" for i, x in enumerate(thresholds()))
ORDINAL = "CASE mode " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(FAILURE_MODES)) + " END"
sql("threshold_sweep", f"""
SELECT CAST(step AS BIGINT) AS step, threshold, count(*) AS total, CAST(count(*) FILTER (1 - worst >= threshold) AS BIGINT) AS accepted, CAST(count(*) FILTER (1 - mean >= threshold) AS BIGINT) AS accepted_mean,
 {", ".join(f"CAST(count(*) FILTER (NOT 1 - worst >= threshold AND worst_mode = '{m}') AS BIGINT) AS worst_{m.lower()}" for m in FAILURE_MODES)}
FROM (SELECT item_id, max(severity) AS worst, CAST(sum(CAST(severity AS DECIMAL(18, 12))) AS DOUBLE) / count(severity) AS mean, arg_max(mode, (severity, -({ORDINAL}))) AS worst_mode FROM fx_severity GROUP BY 1), (VALUES {STEPS}) s(step, threshold) GROUP BY 1, 2""", "fx_severity")  # fmt: skip
MEAN = ", ".join(f"round(avg(severity) FILTER (mode = '{m}'), 6) AS mean_{m.lower()}" for m in FAILURE_MODES)


def _crosstab(by: str) -> str:
    return f"""ct AS (SELECT * FROM (SELECT {by}, count(*) AS items, CAST(count(*) FILTER (accepted) AS BIGINT) AS accepted FROM base GROUP BY 1) LEFT JOIN (SELECT {by}, {MEAN} FROM base JOIN fx_severity USING (item_id) GROUP BY 1) USING ({by}))"""


BUCKET = "CASE WHEN coalesce(f, 0) = 0 THEN '0%' " + " ".join(f"WHEN f > {lo} AND f <= {hi} THEN '{n}'" for n, lo, hi in BUCKETS[1:]) + " END"
sql("composition_crosstab", f"SELECT CAST(position AS BIGINT) AS position, bucket, coalesce(items, 0) AS items, coalesce(accepted, 0) AS accepted, {', '.join(f'mean_{m.lower()}' for m in FAILURE_MODES)} FROM (VALUES {', '.join(f'({i}, {n[0]!r})' for i, n in enumerate(BUCKETS))}) dim(position, bucket) LEFT JOIN ct USING (bucket)",
    "fx_item", "fx_severity", "fx_chunk", more=f"""{DECIDED}, fr AS (SELECT chunk_ord % 50 AS slot, count(*) FILTER (role = 'SOLUTION') / count(*) AS f FROM fx_chunk GROUP BY 1),
 base AS (SELECT i.*, {BUCKET} AS bucket FROM items i LEFT JOIN fr ON fr.slot = i.item_id % 60 WHERE state = 'FILTERED'), {_crosstab("bucket")}""")  # fmt: skip
sql("difficulty_crosstab", "SELECT * REPLACE (CAST(requested_difficulty AS BIGINT) AS requested_difficulty) FROM ct", "fx_item", "fx_severity", more=f"{DECIDED}, base AS (SELECT * FROM items WHERE state = 'FILTERED'), {_crosstab('requested_difficulty')}")
sql("failure_summary", f"""
SELECT run_id, 'attempt' AS kind, stage || ':' || failure_category AS category, count(*) AS n FROM fx_call JOIN fx_item USING (item_id) WHERE failure_category IS NOT NULL AND {ENDED} GROUP BY 1, 3
UNION ALL SELECT run_id, 'permanent', state || ':' || coalesce(failure, 'null'), count(*) FROM fx_item WHERE {ENDED} AND state <> 'FILTERED' GROUP BY 1, 3""", "fx_item", "fx_call")  # fmt: skip
sql("failure_totals", f"""
SELECT *, round(CASE WHEN calls = 0 THEN 0e0 ELSE failed_calls / calls END, 6) AS failed_call_rate FROM (SELECT run_id, completed, failed, coalesce(calls, 0) AS calls, coalesce(failed_calls, 0) AS failed_calls
 FROM (SELECT run_id, CAST(count(*) FILTER (state = 'FILTERED') AS BIGINT) AS completed, CAST(count(*) FILTER (state <> 'FILTERED') AS BIGINT) AS failed FROM fx_item WHERE {ENDED} GROUP BY 1)
 LEFT JOIN (SELECT run_id, count(*) AS calls, count(failure_category) AS failed_calls FROM fx_call JOIN fx_item USING (item_id) WHERE {ENDED} GROUP BY 1) USING (run_id))""", "fx_item", "fx_call")  # fmt: skip
sql("grounding_budget", """
SELECT query_id, count(*) AS snippets, CAST(count(*) FILTER (role = 'SOLUTION') AS BIGINT) AS solutions, CAST(count(*) FILTER (role IS NULL) AS BIGINT) AS unknown_roles, round(count(*) FILTER (role = 'SOLUTION') / count(*), 6) AS solution_fraction,
 CAST(max(so_far) AS BIGINT) AS tokens FROM (SELECT *, sum(100 + chunk_ord * 37 % 400) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM top) WHERE so_far <= 2000 OR rank = 1 GROUP BY 1""", "fx_chunk", more=TOP)  # fmt: skip
sql("interleave_round_robin", """
SELECT panel, row_number() OVER (PARTITION BY panel ORDER BY rank, query_id) AS place, chunk_id FROM (
 SELECT *, row_number() OVER (PARTITION BY panel, chunk_id ORDER BY rank, query_id) AS seen FROM (SELECT *, query_id // 150 AS panel FROM top)) WHERE seen = 1""", "fx_chunk", more=TOP)  # fmt: skip
LECTURE = "split_part(chunk_id, '/', 1)"
sql("subsection_partition", rf"SELECT chunk_id, {LECTURE} AS lecture, ntile(4) OVER (PARTITION BY {LECTURE} ORDER BY split_part(chunk_id, '#', 1), CAST(regexp_extract(chunk_id, '#p([0-9]+)-', 1) AS INTEGER), chunk_id) AS section FROM fx_chunk", "fx_chunk")
sql("batch_plan", """
SELECT item_id, competency_key, language, CAST(batch AS BIGINT) AS batch, row_number() OVER (PARTITION BY competency_key, language, batch ORDER BY item_id) - 1 AS batch_pos FROM (
 SELECT *, CASE WHEN i < x * (b + 1) THEN i // (b + 1) ELSE x + (i - x * (b + 1)) // b END AS batch FROM (SELECT *, n // calls AS b, n % calls AS x FROM (SELECT *, (n + 11) // 12 AS calls FROM (
  SELECT item_id, competency_key, language, row_number() OVER (PARTITION BY competency_key, language ORDER BY item_id) - 1 AS i, count(*) OVER (PARTITION BY competency_key, language) AS n FROM fx_item WHERE state = 'PENDING'))))""", "fx_item")  # fmt: skip
sql("enqueue_ladder", """
SELECT i, 't' || (i % n) AS topic, i // n AS item_index, CAST([20, 40, 60, 80][CAST(i // n % 4 + 1 AS INTEGER)] AS BIGINT) AS level
FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i, (SELECT count(*) FROM supplier) AS n)""")
sql("selection_cleanup", f"""
SELECT request, id, rank FROM (SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY pos) AS rank FROM (SELECT request, id, min(pos) AS pos FROM ({CHOICES}) WHERE id < 50 AND (id + request) % 3 <> 0 GROUP BY 1, 2)) WHERE rank <= 10""")  # fmt: skip
sql("shortlist_batches", "SELECT competency_key, item_id AS id, (row_number() OVER (PARTITION BY competency_key ORDER BY item_id) - 1) // 40 AS batch FROM fx_item WHERE state = 'FILTERED'", "fx_item")
sql("agentic_acceptance", r"""
SELECT quiz_id, q_index, CASE WHEN coalesce(before, 0) >= 2 THEN 'unjudged' WHEN seen > 1 THEN 'duplicate' WHEN ok THEN 'accepted' ELSE 'rejected' END AS status FROM (
 SELECT *, sum(CASE WHEN ok AND seen = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY quiz_id ORDER BY q_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT *, (quiz_id + q_index) % 3 <> 0 AS ok, row_number() OVER (PARTITION BY quiz_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY q_index) AS seen FROM fx_question))""", "fx_question")  # fmt: skip
sql("agentic_rounds", """
SELECT quiz_id, round, accepted FROM (SELECT *, sum(CASE WHEN NOT failed AND accepted = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY quiz_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM (
 SELECT quiz_id, q_index // 2 AS round, CAST(count(*) FILTER ((quiz_id + q_index) % 3 = 0) AS BIGINT) AS accepted, (quiz_id + q_index // 2) % 4 = 0 AS failed FROM fx_question GROUP BY 1, 2)) WHERE coalesce(stops, 0) = 0""", "fx_question")  # fmt: skip
_dash = lambda x, other: f"regexp_replace(regexp_replace({x}, '{other}', '-', 'g'), '^-+|-+$', '', 'g')"
sql("slug_variants", rf"""SELECT doc_id, {_dash("lower(name)", r"[^\p{L}\p{N}]+")} AS letters, {_dash("lower(coalesce(name, ''))", "[^a-z0-9]+")} AS ascii, {_dash("name", "[^A-Za-z0-9._-]+")} AS file, {_dash("lower(name)", r"[^0-9A-Za-z\x{C0}-\x{24F}]+")} AS latin
FROM (SELECT doc_id, text AS name FROM documents)""")  # fmt: skip
sql("unit_roles", rf"""
SELECT document_id, lecture, unit, CASE WHEN contains(n, 'solution') OR contains(n, 'loesung') OR contains(n, 'lösung') THEN 'SOLUTION' WHEN starts_with(n, 'ce ') OR contains(n, 'central exercise') OR contains(n, 'demoaufgaben') THEN 'CENTRAL_EXERCISE'
 WHEN contains(n, 'tutorial') OR contains(n, 'uebungsaufgaben') OR contains(n, 'übungsaufgaben') THEN 'TUTORIAL' WHEN regexp_matches(n, '^[0-9]+[ _]') THEN 'LECTURE_DECK' ELSE 'OTHER' END AS role, {QUERY.format("lecture")} AS query
FROM (SELECT *, lower(unit) AS n FROM (SELECT document_id, CASE WHEN contains(document_id, '/') THEN split_part(document_id, '/', 1) ELSE '(root)' END AS lecture, regexp_replace(regexp_replace(document_id, '^.*/', ''), '(?i)\.pdf$', '') AS unit
 FROM (SELECT CASE WHEN contains(e, '/') THEN split_part(e, '/', 1) || ' ' || k || substr(e, length(split_part(e, '/', 1)) + 1) ELSE k || ' ' || e END AS document_id
  FROM (SELECT p_partkey AS k, string_split('{UNITS}', '|')[p_partkey % 8 + 1] AS e FROM part))))""")  # fmt: skip
sql("chunk_id_parts", f"""
SELECT chunk_id, split_part(chunk_id, '#', 1) AS document, CAST(regexp_extract(chunk_id, '#p([0-9]+)-', 1) AS BIGINT) AS first_page, {LECTURE} AS lecture,
 CASE WHEN chunk_ord % 2 = 0 THEN 'Page ' || chunk_ord ELSE 'Pages ' || chunk_ord || '–' || (chunk_ord + 1) END AS pages FROM fx_chunk""", "fx_chunk")  # fmt: skip
_lost = "state IN ('FAILED_GENERATION', 'FAILED_FILTER') AND coalesce(failure IN ('TIMEOUT', 'TRANSPORT', 'RATE_LIMIT'), false)"
sql("state_transitions", f"""
SELECT item_id, CASE state WHEN 'GENERATING' THEN 'PENDING' WHEN 'FILTERING' THEN 'GENERATED' ELSE state END AS released,
 CASE WHEN item_id % 3 = 0 THEN CASE WHEN item_id % 2 = 0 THEN 'PENDING' ELSE 'GENERATED' END ELSE CASE WHEN item_id % 2 = 0 THEN 'FAILED_GENERATION' ELSE 'FAILED_FILTER' END END AS after_failure,
 coalesce(failure NOT IN ('AUTH', 'BAD_REQUEST'), true) AS retry, CASE WHEN {_lost} THEN CASE state WHEN 'FAILED_GENERATION' THEN 'PENDING' ELSE 'GENERATED' END END AS revived_state,
 CAST(CASE WHEN {_lost} THEN CASE state WHEN 'FAILED_GENERATION' THEN 0 ELSE 2 END END AS BIGINT) AS revived_generation, CAST(CASE WHEN {_lost} THEN CASE state WHEN 'FAILED_GENERATION' THEN 1 ELSE 0 END END AS BIGINT) AS revived_filter FROM fx_item""", "fx_item")  # fmt: skip
_fold = lambda below, n: f"""{n} AS (SELECT k // {FAN} AS k, CASE WHEN (SELECT count(*) FROM {below}) = 1 AND '{below}' <> 'l0' THEN any_value(h)
  ELSE sha256(string_agg(h, chr(10) ORDER BY k)) END AS h FROM {below} GROUP BY k // {FAN})"""  # noqa: E731
sql("corpus_fingerprint", "SELECT h AS fingerprint, (SELECT count(*) FROM l0) AS rows FROM l3", more=f"""
 l0 AS (SELECT row_number() OVER (ORDER BY path) - 1 AS k, sha256(path || chr(0) || sha256(text)) AS h FROM (SELECT source || '/doc' || doc_id AS path, text FROM documents)),
 {_fold("l0", "l1")}, {_fold("l1", "l2")}, {_fold("l2", "l3")}""")
sql("manifest_diff", """
SELECT path, status FROM (SELECT coalesce(d.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN d.path IS NULL THEN 'extra' WHEN d.h <> f.h THEN 'differs' END AS status
 FROM (SELECT 'doc' || doc_id AS path, sha256(text) AS h FROM documents) d FULL JOIN (SELECT CASE WHEN doc_id % 13 = 0 THEN 'doc' || doc_id || 'b' ELSE 'doc' || doc_id END AS path, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0) f ON d.path = f.path)
WHERE status IS NOT NULL""")  # fmt: skip
sql("material_manifest", """
SELECT course_key || '/' || competency_key AS path, array_to_string(list_sort(list(DISTINCT 'd' || (item_id % 9))), ',') AS documents FROM (SELECT DISTINCT course_key, competency_key FROM fx_request WHERE request_key <> 'r3') r
JOIN (SELECT CASE WHEN language = 'de' THEN 'EIDI' ELSE 'PSE' END AS course_key, competency_key, item_id FROM fx_item) i USING (course_key, competency_key) GROUP BY 1""", "fx_item", "fx_request")  # fmt: skip
sql("competency_topics", """
SELECT competency_key, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks FROM (SELECT DISTINCT competency_key FROM fx_item) c
LEFT JOIN (SELECT competency_key, 'lec' || (item_id % 12) || '/deck' || (item_id % 7) || '.pdf' AS document_id FROM fx_item) l USING (competency_key)
LEFT JOIN (SELECT split_part(chunk_id, '#', 1) AS document_id, count(*) AS n FROM fx_chunk GROUP BY 1) k USING (document_id) GROUP BY 1""", "fx_item", "fx_chunk")  # fmt: skip
sql("attempt_totals", "SELECT count(*) AS attempts, CAST(count(*) FILTER (outcome = 'success') AS BIGINT) AS correct FROM fx_call", "fx_call")
sql("lecture_listing", "SELECT source AS lecture, count(*) AS documents FROM documents GROUP BY 1")
sql("next_claims", "SELECT item_id, state FROM fx_item WHERE run_id = 'run-3' AND state IN ('GENERATED', 'PENDING') ORDER BY state, competency_key, item_id LIMIT 20", "fx_item")
sql("items_by_title", """
SELECT i.competency_key AS topic_key, t.competency_key AS titled_key, taxonomy, count(*) AS items FROM fx_item i LEFT JOIN (SELECT * FROM ti a WHERE ord = (SELECT min(ord) FROM ti b WHERE b.title = a.title)) t ON t.title = i.competency_key
WHERE state = 'FILTERED' GROUP BY 1, 2, 3""", "fx_item", more=f"ti AS ({TITLES})")  # fmt: skip
sql("chunk_roles", "SELECT lecture, CASE WHEN document_id LIKE 'src1%' THEN 'TUTORIAL' ELSE 'OTHER' END AS role, count(*) AS chunks FROM ch GROUP BY 1, 2", "fx_page", more=CHUNKED)
sql("pool_summary", """
SELECT *, (SELECT array_to_string(list_sort(list(DISTINCT judge_model)), ',') FROM fx_verdict WHERE item_id IN (SELECT item_id FROM fx_item WHERE configuration_id = 'pool|local')) AS judges FROM (
 SELECT CAST(count(*) FILTER (state IN ('GENERATED', 'FILTERING', 'FILTERED', 'FAILED_FILTER')) AS BIGINT) AS generated, CAST(count(*) FILTER (state NOT IN ('GENERATED', 'FILTERING', 'FILTERED', 'FAILED_FILTER')) AS BIGINT) AS not_generated,
  count(DISTINCT competency_key) AS competencies FROM fx_item WHERE configuration_id = 'pool|local')""", "fx_item", "fx_verdict")  # fmt: skip
sql("judges_of_generators", """
SELECT generator, string_agg(judge, ',' ORDER BY ord) AS judges, arg_min(judge, ord) AS primary_judge FROM (SELECT generator, judge, min(ord) AS ord FROM j WHERE approach = 'two-phase' GROUP BY 1, 2) GROUP BY 1""", more=f"j AS ({JUDGES})")  # fmt: skip
sql("configuration_counts", "SELECT concat_ws('|', approach, generator, judge, selector) AS configuration_id, count(*) AS n, min(ord) AS first FROM j GROUP BY 1", more=f"j AS ({JUDGES})")
sql("text_functions", r"""
SELECT id, CASE WHEN trim(coalesce(query, '')) <> '' THEN query WHEN trim(description) = '' THEN title ELSE title || '. ' || replace(replace(description, chr(10), ' '), '- ', '') END AS retrieval_query,
 replace(type, '-', '_') AS type_name, CASE lower(code) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE code END AS language,
 model = other OR starts_with(model, other || ':') OR starts_with(other, model || ':') AS same_model,
 split_part(string_split(manifest, chr(10))[4], '=', 2) AS a, substr(string_split(manifest, chr(10))[2], 3) AS b FROM x""", more=f"x AS ({TEXTS})")
sql("results_by_generator", f"""
SELECT generator_id, metric_name, count(*) AS results, round(avg(score), 6) AS mean_score, 'question' AS scope FROM res JOIN (SELECT quiz_id, {NUMBERED} AS question_id, 'g' || (quiz_id % 3) AS generator_id FROM fx_question) s USING (quiz_id, question_id)
WHERE applicable GROUP BY 1, 2 UNION ALL
SELECT 'g' || (quiz_id % 3), metric_name, count(*), round(avg(score), 6), 'quiz' FROM res WHERE applicable AND question_id IS NULL AND quiz_id IN (SELECT quiz_id FROM fx_question) GROUP BY 1, 2""", "fx_question", more=f"res AS ({RESULTS})")  # fmt: skip

_pct = lambda x: f"CAST(floor(({x}) * 100 + 0.5e0) AS BIGINT) || '%'"
# amounts of six digits are rounded half up in decimals, as Java prints them
_four = lambda x: f"CAST(round(CAST({x} AS DECIMAL(18, 6)), 4) AS DECIMAL(18, 4))::VARCHAR"
_band = lambda a, b: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'n/a' WHEN {a} = {b} THEN {_four(a)} ELSE {_four(a)} || '-' || {_four(b)} END"
ORACLES["cost_report"] = f"""SELECT configuration_id, items, accepted, failed, CASE WHEN items = 0 THEN '-' ELSE {_pct("accepted / items")} END AS accept_rate,
 {_band("low_eur", "high_eur")} AS total_eur, {_band("per_item_low", "per_item_high")} AS eur_per_item, {_band("per_accepted_low", "per_accepted_high")} AS eur_per_accepted
FROM ({ORACLES["cost_per_configuration"]})"""
sql("grounding_descriptions", f"""
SELECT query_id, array_to_string(list_filter([CASE WHEN decks > 0 THEN decks || ' lecture deck' END, CASE WHEN solutions > 0 THEN solutions || ' solution' END, CASE WHEN tutorials > 0 THEN tutorials || ' tutorial' END,
  CASE WHEN unknown > 0 THEN unknown || ' unknown' END], lambda x: x IS NOT NULL), ', ') || ' (' || {_pct("solutions / n")} || ' solution)' AS composition
FROM (SELECT query_id, count(*) AS n, count(*) FILTER (role = 'LECTURE_DECK') AS decks, count(*) FILTER (role = 'SOLUTION') AS solutions, count(*) FILTER (role = 'TUTORIAL') AS tutorials,
  count(*) FILTER (role IS NULL) AS unknown FROM top GROUP BY 1)""", "fx_chunk", more=TOP)
sql("page_totals", """
SELECT 'export' AS page, count(*) AS items, CAST(count(*) FILTER (accepted) AS BIGINT) AS accepted, count(DISTINCT configuration_id) AS configurations
FROM items WHERE state = 'FILTERED' AND run_id IN (SELECT run_id FROM fx_run)
UNION ALL SELECT configuration_id, count(*), CAST(count(*) FILTER (accepted) AS BIGINT), 1 FROM items WHERE configuration_id LIKE 'agentic|%' AND state = 'FILTERED' GROUP BY 1""",
    "fx_item", "fx_severity", "fx_run", more=DECIDED)
