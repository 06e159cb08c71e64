"""Adapter views: the driver's tables in the shapes of the store. The same statements serve Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "fx_item": """
SELECT o_orderkey AS item_id, concat('run-', substr(o_orderpriority, 1, 1)) AS run_id,
 CASE o_custkey % 3 WHEN 0 THEN 'agentic|local|local|local' WHEN 1 THEN 'two-phase|local|cloud|cloud' ELSE 'pool|local' END AS configuration_id,
 concat('c', CAST(o_custkey % 16 AS VARCHAR(10))) AS competency_key,
 CASE o_orderkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty_band,
 CASE o_orderkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 40 WHEN 2 THEN 60 ELSE 80 END AS requested_difficulty,
 CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'de' END AS language,
 CASE o_orderstatus WHEN 'F' THEN 'FILTERED' WHEN 'O' THEN CASE o_custkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'GENERATING' WHEN 2 THEN 'GENERATED' ELSE 'FILTERING' END
   ELSE CASE o_custkey % 2 WHEN 0 THEN 'FAILED_GENERATION' ELSE 'FAILED_FILTER' END END AS state,
 CASE WHEN o_orderstatus = 'P' THEN CASE o_orderkey % 5 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'TRANSPORT' WHEN 2 THEN 'RATE_LIMIT' WHEN 3 THEN 'VALIDATION_VIOLATION' ELSE 'AUTH' END END AS failure,
 o_orderdate AS updated_at FROM orders""",
    "fx_severity": """
SELECT l_orderkey AS item_id, l_linenumber AS mode_ord,
 CASE l_linenumber WHEN 1 THEN 'FACTUAL_ERROR' WHEN 2 THEN 'AMBIGUOUS_CORRECT_ANSWER' WHEN 3 THEN 'OFF_TOPIC' WHEN 4 THEN 'NEAR_DUPLICATE' WHEN 5 THEN 'ILL_FORMED_DISTRACTORS'
   WHEN 6 THEN 'COMPETENCY_MISMATCH' ELSE 'DIFFICULTY_MISMATCH' END AS mode,
 max(l_discount * 10) AS severity FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_call": """
SELECT event_id AS call_id, CAST(floor(event_id / 2e0) AS BIGINT) AS item_id,
 CASE event_type WHEN 'view' THEN 'selection' WHEN 'click' THEN 'filter' WHEN 'signup' THEN 'embedding' ELSE 'generation' END AS stage,
 CASE user_id % 4 WHEN 0 THEN 'openai/gpt-oss-120b' WHEN 1 THEN 'gpt-5-mini' WHEN 2 THEN 'gpt-5.4' ELSE 'mystery' END AS model,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS prompt_tokens,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS completion_tokens,
 CAST(floor(value * 1000) AS BIGINT) AS wall_clock_ms,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS outcome,
 CASE WHEN event_type = 'error' THEN CASE user_id % 5 WHEN 0 THEN 'AUTH' WHEN 1 THEN 'BAD_REQUEST' WHEN 2 THEN 'RATE_LIMIT' WHEN 3 THEN 'TIMEOUT' ELSE 'TRANSPORT' END END AS failure_category,
 ts FROM events""",
    "fx_event": """
SELECT concat('run-', CAST(user_id % 4 + 1 AS VARCHAR(10))) AS run_id, user_id AS item_id, event_id AS seq, ts AS at,
 CASE event_type WHEN 'signup' THEN 'ENQUEUE' WHEN 'view' THEN 'CLAIM' WHEN 'click' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' ELSE 'REVIVE' END AS kind,
 CASE event_id % 4 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'AUTH' WHEN 2 THEN 'RATE_LIMIT' ELSE 'VALIDATION_VIOLATION' END AS failure FROM events""",
    "fx_verdict": """
SELECT l_orderkey AS item_id, CASE l_suppkey % 2 WHEN 0 THEN 'judge-local' ELSE 'judge-cloud' END AS judge_model, 'GENERAL' AS scope, max(l_discount) <= 0.05 AS accepted
FROM lineitem GROUP BY 1, 2""",
    "fx_question": "SELECT conv_id AS quiz_id, turn AS q_index, role, text FROM conversations",
    "fx_chunk": """
SELECT vec_id AS chunk_ord, concat('lec', CAST(label AS VARCHAR(10)), '/deck', CAST(vec_id % 7 AS VARCHAR(10)), '.pdf#p', CAST(vec_id AS VARCHAR(10)), '-', CAST(vec_id + 1 AS VARCHAR(10))) AS chunk_id,
 CASE WHEN label = 0 THEN 'SOLUTION' WHEN label = 1 THEN 'TUTORIAL' WHEN label = 2 THEN NULL ELSE 'LECTURE_DECK' END AS role, embedding FROM embeddings""",
    "fx_run": "SELECT 'run-1' AS run_id UNION ALL SELECT 'run-2' UNION ALL SELECT 'run-3' UNION ALL SELECT 'run-4'",
    "fx_price": """
SELECT 'openai/gpt-oss-120b' AS model, 'gpu-time' AS billing, 0e0 AS input_eur, 0e0 AS output_eur
UNION ALL SELECT 'gpt-5-mini', 'tokens', 0.23e0, 1.84e0 UNION ALL SELECT 'gpt-5.4', 'tokens', 2.30e0, 13.80e0""",
    "fx_configuration": """
SELECT 0 AS ord, 'agentic|local|local|local' AS configuration_id, 'agentic' AS approach, 'local' AS generator, 'openai/gpt-oss-120b' AS generator_model, 'openai/gpt-oss-120b' AS judge_model
UNION ALL SELECT 1, 'two-phase|local|cloud|cloud', 'two-phase', 'local', 'openai/gpt-oss-120b', 'gpt-5.4'""",
    "fx_request": """
SELECT 'r1' AS request_key, 'EIDI' AS course_key, 'c1' AS competency_key, 'de' AS language, 'single-choice' AS question_type, 10 AS n, 'medium' AS difficulty
UNION ALL SELECT 'r2', 'PSE', 'c2', 'en', 'multiple-choice', 5, 'easy' UNION ALL SELECT 'r3', 'OR', 'c3', 'en', 'true-false', 20, 'hard'""",
}
#: Questions with every defect, from parts: the branch is the key modulo 12.
VIEWS["fx_mcq"] = """
SELECT p_partkey AS item_id, CASE WHEN p_partkey % 12 = 10 THEN 'true-false' WHEN p_partkey % 12 = 11 THEN 'multiple-choice' ELSE 'single-choice' END AS type,
 CASE WHEN p_partkey % 12 = 0 THEN ' ' ELSE p_name END AS title,
 CASE WHEN p_partkey % 12 = 1 THEN 'Solve the following linear program for x.' WHEN p_partkey % 24 = 13 THEN concat('Das folgende Tableau:', chr(10), '1 2') ELSE concat('What is ', p_name, '?') END AS question_text,
 concat(p_brand, ' first') AS opt1,
 CASE WHEN p_partkey % 12 = 3 THEN '  ' WHEN p_partkey % 12 = 4 THEN upper(concat(p_brand, ' first')) WHEN p_partkey % 12 = 5 THEN 'None of the above' WHEN p_partkey % 12 = 6 THEN concat('the ', p_brand, '  FIRST, really') ELSE concat(p_type, ' second') END AS opt2,
 CASE WHEN p_partkey % 12 = 8 THEN concat(p_type, ' a very long and most explicit third choice that stands out') ELSE concat('size ', CAST(p_size AS VARCHAR(10)), ' third') END AS opt3,
 CASE WHEN p_partkey % 12 = 2 THEN NULL WHEN p_partkey % 36 = 9 THEN 'a and b' ELSE concat(p_name, ' fourth.') END AS opt4,
 p_partkey % 12 IN (7, 11) AS c1, p_partkey % 12 = 11 AS c2, p_partkey % 12 <> 9 AS c3, p_partkey % 12 = 7 AS c4 FROM part"""

PAGE_SPARK = r"""
SELECT doc_id, source AS lecture, concat(source, '/doc', CAST(doc_id AS STRING), '.pdf') AS document_id, concat('doc', CAST(doc_id AS STRING)) AS unit,
 p.pos + 1 AS page_number, p.col AS text FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS pos, col"""
PAGE_DUCK = """
SELECT doc_id, source AS lecture, concat(source, '/doc', CAST(doc_id AS VARCHAR), '.pdf') AS document_id, concat('doc', CAST(doc_id AS VARCHAR)) AS unit,
 generate_subscripts(string_split(text, chr(10)), 1) AS page_number, unnest(string_split(text, chr(10))) AS text FROM documents"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Fixtures:
    """The adapter views of one data folder as DataFrames; each is read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        sql = PAGE_SPARK if name == "page" else VIEWS.get(f"fx_{name}")
        if sql is None:
            raise AttributeError(name)
        used = {t: self.table(t) for t in TABLES if f"FROM {t}" in sql}
        # names are bound as arguments, so that no view is registered in the session
        for t in used:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        return self.spark.sql(sql, **used) if used else self.spark.sql(sql)


def ctes(*names: str) -> str:
    """``WITH`` clause of the views for DuckDB."""
    return "WITH RECURSIVE " + ",\n ".join(f"{n} AS ({PAGE_DUCK if n == 'fx_page' else VIEWS[n]})" for n in names)
