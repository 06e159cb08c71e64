"""Queries that run as jobs of their own: streams, data sources, indexes and sinks over the given tables, each with its SQL."""

from __future__ import annotations

import sqlite3
from contextlib import closing
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import Fixtures, ctes
from ..operators import cell_index, corpus, export, retrieval, store
from ..scratch import new_folder, written
from ..sources import course_files, exports, files, pdf, sqlite_store
from ..streaming import machine
from . import catalogue, oracle
from .catalogue import TOP_K, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def job(sql: str):
    """Register ``f(fx)`` as a query of its name with its DuckDB statement."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


RULES = machine.Rules(attempts=3, stale_ms=12 * 3_600_000)

#: One step an event: a claim whose time is up goes back first, then the event applies or doesn't.
WALK = f"""e AS (SELECT run_id, item_id, epoch_ms(fx_event."at") AS ms, kind, failure,
   row_number() OVER (PARTITION BY run_id, item_id ORDER BY epoch_ms(fx_event."at"), seq) AS k FROM fx_event),
 walk AS (
  SELECT DISTINCT run_id, item_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS state, 0 AS ga, 0 AS fa,
   CAST(NULL AS VARCHAR) AS failure, CAST(NULL AS BIGINT) AS deadline, CAST(0 AS BIGINT) AS changes, CAST(0 AS BIGINT) AS stale FROM e
  UNION ALL
  SELECT run_id, item_id, k, coalesce(too, s), CASE WHEN too IS NULL THEN ga WHEN kind = 'ENQUEUE' OR (kind = 'REVIVE' AND gen) THEN 0
     WHEN kind IN ('SUCCESS', 'FAILURE') AND gen THEN ga + 1 ELSE ga END,
   CASE WHEN too IS NULL THEN fa WHEN kind = 'ENQUEUE' OR (kind = 'REVIVE' AND NOT gen) THEN 0 WHEN kind IN ('SUCCESS', 'FAILURE') AND NOT gen THEN fa + 1 ELSE fa END,
   CASE WHEN too IS NULL OR kind = 'CLAIM' THEN failure WHEN kind = 'FAILURE' THEN f END,
   CASE WHEN too IS NULL THEN d WHEN kind = 'CLAIM' THEN ms + {RULES.stale_ms} END,
   changes + CAST(too IS NOT NULL AS BIGINT) + CAST(late AS BIGINT), stale + CAST(late AS BIGINT)
  FROM (SELECT *, CASE
     WHEN kind = 'ENQUEUE' AND (s IS NULL OR closed) THEN 'PENDING'
     WHEN closed THEN NULL
     WHEN kind = 'CLAIM' AND s = 'PENDING' THEN 'GENERATING' WHEN kind = 'CLAIM' AND s = 'GENERATED' THEN 'FILTERING'
     WHEN kind = 'SUCCESS' AND s = 'GENERATING' THEN 'GENERATED' WHEN kind = 'SUCCESS' AND s = 'FILTERING' THEN 'FILTERED'
     WHEN kind = 'FAILURE' AND s = 'GENERATING' THEN CASE WHEN ga + 1 < {RULES.attempts} AND f NOT IN ('AUTH', 'BAD_REQUEST') THEN 'PENDING' ELSE 'FAILED_GENERATION' END
     WHEN kind = 'FAILURE' AND s = 'FILTERING' THEN CASE WHEN fa + 1 < {RULES.attempts} AND f NOT IN ('AUTH', 'BAD_REQUEST') THEN 'GENERATED' ELSE 'FAILED_FILTER' END
     WHEN kind = 'REVIVE' AND s = 'FAILED_GENERATION' THEN 'PENDING' WHEN kind = 'REVIVE' AND s = 'FAILED_FILTER' THEN 'GENERATED' END AS too
   FROM (SELECT *, s IN ('PENDING', 'GENERATING', 'FAILED_GENERATION') AS gen,
      s = 'FILTERED' OR (s LIKE 'FAILED%' AND coalesce(failure NOT IN ('TIMEOUT', 'TRANSPORT', 'RATE_LIMIT'), true)) AS closed
     FROM (SELECT w.run_id, w.item_id, e.k, w.ga, w.fa, w.failure, w.changes, w.stale, e.ms, e.kind, e.failure AS f,
        coalesce(e.ms >= w.deadline, false) AS late,
        CASE WHEN e.ms >= w.deadline THEN CASE w.state WHEN 'GENERATING' THEN 'PENDING' ELSE 'GENERATED' END ELSE w.state END AS s,
        CASE WHEN e.ms >= w.deadline THEN NULL ELSE w.deadline END AS d
       FROM walk w JOIN e ON e.run_id = w.run_id AND e.item_id = w.item_id AND e.k = w.k + 1)))),
 ended AS (SELECT *, coalesce(deadline < (SELECT max(ms) FROM e), false) AS late FROM walk
   QUALIFY row_number() OVER (PARTITION BY run_id, item_id ORDER BY k DESC) = 1),
 final AS (SELECT run_id, item_id, CASE WHEN late THEN CASE state WHEN 'GENERATING' THEN 'PENDING' ELSE 'GENERATED' END ELSE state END AS state,
   ga AS generation_attempts, fa AS filter_attempts, failure, changes + CAST(late AS BIGINT) AS changes, stale + CAST(late AS BIGINT) AS stale
   FROM ended WHERE state IS NOT NULL)"""


def _replayed(fx: Fixtures, slices: int) -> tuple[DataFrame, str]:
    folder = new_folder(fx.spark)
    return machine.replay(fx.event, folder, slices, RULES), folder


@job(f"{ctes('fx_event')},\n {WALK}\nSELECT * FROM final")
def live_item_states(fx):
    """The event log replayed as a stream in three spans of time, stopped and taken up again between them."""
    changes, _ = _replayed(fx, 3)
    n = changes.groupBy("run_id", "item_id").agg(F.count(F.lit(1)).alias("changes"), F.sum((F.col("cause") == "STALE").cast("long")).alias("stale"))
    now = machine.states(changes).select("run_id", "item_id", "state", "generation_attempts", "filter_attempts", "failure")
    return now.join(n, ["run_id", "item_id"])


CLOSED = "(state = 'FILTERED' OR (state LIKE 'FAILED%' AND coalesce(failure NOT IN ('TIMEOUT', 'TRANSPORT', 'RATE_LIMIT'), true)))"


@job(f"""{ctes('fx_event')},\n {WALK},
 steps AS (SELECT *, lag(changes) OVER (PARTITION BY run_id, item_id ORDER BY k) AS before FROM walk),
 lives AS (SELECT run_id, state FROM steps WHERE changes > before AND {CLOSED} UNION ALL SELECT run_id, state FROM final WHERE NOT {CLOSED})
SELECT run_id, state, count(*) AS items FROM lives GROUP BY 1, 2""")
def live_state_counts(fx):
    """How many items of a run are in each state, by a second stream over the changes of the first."""
    _, folder = _replayed(fx, 2)
    machine.count_states(fx.spark, f"{folder}/changes", f"{folder}/counts-checkpoint", f"{folder}/counts")
    return machine.latest_counts(fx.spark, f"{folder}/counts")


def _decks(fx: Fixtures, suffix: str, content) -> str:
    """The documents as files of their source's folder, by way of the export sink: ``content`` is a file's bytes."""
    path = new_folder(fx.spark)
    docs = fx.table("documents").where("doc_id is not null and text is not null")
    name = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(suffix))
    exports.write_files(docs.select(name.alias("file"), content(F.col("text")).alias("content")), path, listed=True)
    return exports.current(path)


def _as_pdf(text):
    return F.udf(lambda t: pdf.simple(t.split("\n")), "binary")(text)


@job(f"""{ctes('fx_page')}
SELECT document_id, lecture, unit, page_number, sha256(trim(text)) AS text_sha256, length(trim(text)) AS n_chars FROM fx_page WHERE text IS NOT NULL""")
def pdf_pages(fx):
    """Documents written as PDF files, a line a page, and read back from the files."""
    found = course_files.pages(fx.spark, _decks(fx, ".pdf", _as_pdf), partitionBytes=1 << 20)
    text = F.trim("text")
    return found.select(
        "document_id", "lecture", "unit", F.col("page_number").cast("long").alias("page_number"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.length(text).cast("long").alias("n_chars")
    )


@job("""
WITH f AS (SELECT source AS lecture, source || '/doc' || doc_id || '.txt' AS file, octet_length(encode(text)) AS bytes, sha256(text) AS h
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT lecture, count(*) AS decks, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(file || chr(0) || h || chr(10), '' ORDER BY file)) AS sha256 FROM f GROUP BY 1""")
def course_provenance(fx):
    """Sizes and one hash a folder over files that the documents were written to."""
    found = course_files.files(fx.spark, _decks(fx, ".txt", lambda text: text.cast("binary")), partitionBytes=1 << 20)
    return course_files.provenance(found).drop("pages")


@job(f"""{ctes('fx_item')}
SELECT 'runs/' || run_id || '.jsonl' AS file, row_number() OVER (PARTITION BY run_id ORDER BY competency_key, item_id) AS line_number,
 sha256('{{"item_id":' || item_id || ',"configuration_id":"' || configuration_id || '","topic":"' || competency_key || '","state":"' || state || '"}}') AS line_sha256
FROM fx_item WHERE state = 'FILTERED'""")
def run_log_export(fx):
    """The run logs, a record of each filtered item by topic and index, written as one transaction and read back."""
    path = new_folder(fx.spark)
    items = fx.item.where("state = 'FILTERED'")
    record = F.to_json(F.struct("item_id", "configuration_id", F.col("competency_key").alias("topic"), "state"))
    file = F.concat(F.lit("runs/"), "run_id", F.lit(".jsonl"))
    exports.write_lines(items.select(file.alias("file"), record.alias("line"), "competency_key", "item_id"), path, ["competency_key", "item_id"])
    parts = exports.read(fx.spark, path).select(
        F.regexp_extract("file", "^(.*)/part-", 1).alias("file"), F.regexp_extract("file", "part-([0-9]+)$", 1).alias("part"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("at", "line")
    ).where("line <> ''")
    # a line's number in its file: those of the parts before, counted, and its place in its own
    sizes = parts.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")
    numbered = parts.join(sizes.withColumn("before", before).drop("n"), ["file", "part"])
    return numbered.select("file", (F.col("before") + F.col("at") + 1).alias("line_number"), F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


def _as_stores(rows):
    """Rows of items as SQLite store files, one for each batch of a task."""
    for batch in rows:
        if not batch.num_rows:
            continue
        with closing(sqlite3.connect(":memory:")) as c:
            c.execute("CREATE TABLE item (item_id INTEGER PRIMARY KEY, run_id TEXT NOT NULL, competency_key TEXT, state TEXT NOT NULL, requested_difficulty INTEGER, failure TEXT)")
            c.execute("CREATE INDEX item_by_state ON item (run_id, state)")
            c.executemany("INSERT INTO item VALUES (?, ?, ?, ?, ?, ?)", zip(*(col.to_pylist() for col in batch.columns)))
            c.commit()
            name = f"part-{batch.column(0)[0].as_py()}.db"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c.serialize()], pa.binary())], ["file", "content"])


@job(f"""{ctes('fx_item')}
SELECT item_id, run_id, competency_key, state, requested_difficulty, failure FROM fx_item WHERE state IN ('FAILED_GENERATION', 'FAILED_FILTER') AND requested_difficulty >= 40""")
def sqlite_failed_items(fx):
    """Items written to SQLite stores and scanned by ranges of row ids; the conditions are part of SQLite's statement."""
    path = new_folder(fx.spark)
    items = fx.item.select("item_id", "run_id", "competency_key", "state", F.col("requested_difficulty").cast("long"), "failure")
    exports.write_files(items.mapInArrow(_as_stores, exports.SCHEMA), path)
    where = [["state", "IN", ["FAILED_GENERATION", "FAILED_FILTER"]], ["requested_difficulty", ">=", 40]]
    found = sqlite_store.scan(fx.spark, exports.current(path), "item", where=where, rows=2000)
    return found.drop("rowid").withColumn("requested_difficulty", F.col("requested_difficulty").cast("int"))


@job(oracle.ORACLES["cosine_topk"])
def cosine_topk_by_cells(fx):
    """The best chunks of each query by way of the cells of an index: the rows of ``cosine_topk``."""
    index = fx.chunk
    queries = index.where("chunk_ord % 50 = 0").select(F.col("chunk_ord").alias("query_id"), F.col("embedding").alias("query_vector"))
    found, _ = cell_index.top_k(queries, cell_index.build(index), TOP_K)
    return rounded(found.select("query_id", "chunk_id", "rank", "score"), "score")


def _csv_back(fx: Fixtures, rows: DataFrame, columns: list[str], order: list[str], schema: str) -> DataFrame:
    """Rows written as a CSV export and read back with Spark's reader."""
    path = new_folder(fx.spark)
    lines = rows.select(F.lit("report.csv").alias("file"), export.csv_line(*columns).alias("line"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    exports.write_lines(lines, path, [f"o{i}" for i in range(len(order))], header=",".join(f'"{c}"' for c in columns))
    return fx.spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{exports.current(path)}/report.csv")


@job(f"{ctes('fx_chunk')},\n {oracle.TOP}\nSELECT query_id AS topic, rank, printf('%.4f', score) AS score, split_part(chunk_id, '#', 1) AS document, chunk_id AS \"chunkId\" FROM top")
def retrieval_probe_export(fx):
    """The retrieval probe as a CSV export, read back."""
    index = fx.chunk
    queries = index.where("chunk_ord % 50 = 0").select(F.col("chunk_ord").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = export.retrieval_csv(retrieval.top_k(queries, index, TOP_K))
    return _csv_back(fx, rows, ["topic", "rank", "score", "document", "chunkId"], ["topic", "rank"], "topic long, rank long, score string, document string, chunkId string")


@job(oracle.ORACLES["doc_extraction_report"])
def extraction_csv_export(fx):
    """The extraction report as a CSV export, read back with its types."""
    rows = corpus.document_report(fx.page.select("document_id", "lecture", "unit", "page_number", "text"))
    return _csv_back(fx, rows, rows.columns, ["document_id"], ", ".join(f"{n} {k}" for n, k in rows.dtypes))


@job(oracle.ORACLES["public_questions"])
def sweep_export_questions(fx):
    """An experiment's quizzes, sidecars and instructions written as one transaction; the public questions read back from their files."""
    path = new_folder(fx.spark)
    q = fx.question.withColumn("competency_key", F.concat(F.lit("c"), (F.col("quiz_id") % 5).cast("string")))
    made = export.sweep_files(catalogue._quiz_requests(fx), q, fx.spark.sql(catalogue.REQUESTS), fx.spark.sql(catalogue.COMPETENCIES))
    exports.write_files(made, path)
    question = "question_id string, question string, domain string, language string, competency string, learning_objective string, bloom_intended string"
    quiz = F.from_json(F.col("content").cast("string"), f"quiz_id long, questions array<struct<{question.replace(' string', ':string')}>>")
    files = exports.read(fx.spark, path).where("file like 'quizzes/%'").select(quiz.alias("q"))
    return files.select("q.quiz_id", F.inline("q.questions"))


def _keyed(fx: Fixtures) -> DataFrame:
    """The items of the view with the store's key."""
    return fx.item.select(
        "item_id", "run_id", "configuration_id", F.col("competency_key").alias("topic_key"), F.col("item_id").cast("int").alias("item_index"), "language", "difficulty_band", "state", "failure"
    )


@job(f"""{ctes('fx_item')}, one AS (SELECT run_id, configuration_id, competency_key, CASE
  WHEN state = 'PENDING' OR state LIKE 'GENERAT%' THEN 'GENERATED' WHEN failure = 'AUTH' THEN 'FAILED_GENERATION' WHEN failure IS NOT NULL THEN 'PENDING' ELSE 'FILTERED' END AS now FROM fx_item)
SELECT run_id, now AS state, count(*) AS items, CAST(count(*) FILTER (now <> 'FILTERED') AS BIGINT) AS generation_attempts,
 CAST(count(*) FILTER (now = 'FILTERED') AS BIGINT) AS filter_attempts, (SELECT count(*) FROM fx_item) AS created FROM one GROUP BY 1, 2""")
def store_item_versions(fx):
    """Items enqueued in two writes that overlap, then moved on by success and failure: each a new version, the newest counts."""
    s, items = store.Store(fx.spark, new_folder(fx.spark)), _keyed(fx)
    new = items.drop("state", "failure")
    created = s.enqueue(new.where("item_index % 3 <> 0")) + s.enqueue(new) + s.enqueue(new.where("item_index % 2 = 0"))
    had = items.select("item_id", F.col("failure").alias("why"), "state")
    claimed = s.read("item").drop("state").join(had, "item_id")
    to_filter = F.expr("not (state = 'PENDING' or state like 'GENERAT%') and why is null")
    claimed = claimed.withColumn("state", F.when(to_filter, "FILTERING").otherwise("GENERATING"))
    s.append("item", claimed.drop("why"))
    before = s.read("item").join(had.select("item_id", "why", F.col("state").alias("had")), "item_id")
    fine = F.expr("had = 'PENDING' or had like 'GENERAT%'")
    done = before.where((F.col("state") == "GENERATING") & fine).withColumns(store.after_success("GENERATING"))
    judged = before.where("state = 'FILTERING'").withColumns(store.after_success("FILTERING"))
    category = F.col("why")
    lost = before.where((F.col("state") == "GENERATING") & ~fine).withColumns(store.after_failure(category, store.may_retry(F.col("generation_attempts"), 3, category)))
    for rows in (done, judged, lost):
        s.append("item", written(rows.drop("why", "had")))
    out = s.read("item").groupBy("run_id", "state").agg(
        F.count(F.lit(1)).alias("items"), F.sum("generation_attempts").alias("generation_attempts"), F.sum("filter_attempts").alias("filter_attempts")
    )
    return out.withColumn("created", F.lit(created).cast("long"))


@job(f"""{ctes('fx_verdict', 'fx_question')}
SELECT 'verdict' AS kind, judge_model AS name, count(*) AS rows, CAST(count(*) FILTER (CASE WHEN item_id % 5 = 0 THEN NOT accepted ELSE accepted END) AS BIGINT) AS told FROM fx_verdict GROUP BY 1, 2
UNION ALL SELECT 'quiz', 'request' || (q % 3), count(*), CAST(count(*) FILTER (q % 4 = 0) AS BIGINT) FROM (SELECT DISTINCT quiz_id AS q FROM fx_question) GROUP BY 1, 2
UNION ALL SELECT 'document', source, count(*), CAST(count(*) FILTER (doc_id % 7 = 0) AS BIGINT) FROM documents GROUP BY 1, 2
UNION ALL SELECT 'attempt', event_type, count(*), CAST(count(*) FILTER (value > 10) AS BIGINT) FROM events GROUP BY 1, 2""")
def store_replacements(fx):
    """Verdicts, quizzes and document hashes written again for some of their keys, and attempts appended: what the store holds then."""
    s = store.Store(fx.spark, new_folder(fx.spark))
    v = fx.verdict.select("item_id", "judge_model", "scope", "accepted")
    s.append("verdict", v)
    s.append("verdict", v.where("item_id % 5 = 0").withColumn("accepted", ~F.col("accepted")))
    quiz = fx.question.select(F.col("quiz_id").alias("q")).distinct().select(
        F.concat(F.lit("quiz"), "q").alias("quiz_id"), F.lit("run").alias("run_id"), F.lit("c").alias("configuration_id"), F.concat(F.lit("request"), F.col("q") % 3).alias("request_key"),
        F.col("q").cast("int").alias("repetition"), F.lit(False).alias("complete"),
    )
    s.append("quiz", quiz)
    # another quiz id for the same place replaces it as well
    s.append("quiz", quiz.where("repetition % 4 = 0").withColumns({"quiz_id": F.concat("quiz_id", F.lit("b")), "complete": F.lit(True)}))
    d = fx.table("documents").select(F.col("source").alias("course_key"), F.col("doc_id").cast("string").alias("document"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    s.append("document", d)
    s.append("document", d.where("doc_id % 7 = 0").withColumn("content_hash", F.lit("new")))
    e = fx.table("events").select(F.col("event_id").alias("item_id"), F.col("event_type").alias("chosen_option"), (F.col("value") > 10).alias("correct"))
    s.append("attempt", e)
    count = lambda rows, kind, name, told: rows.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.sum(told.cast("long")).alias("told"))
    found = [
        count(s.read("verdict"), "verdict", "judge_model", F.col("accepted")), count(s.read("quiz"), "quiz", "request_key", F.col("complete")),
        count(s.read("document"), "document", "course_key", F.col("content_hash") == "new"), count(s.read("attempt"), "attempt", "chosen_option", F.col("correct")),
    ]
    return reduce(DataFrame.union, found)


@job("""
SELECT 'p' || p_partkey AS topic, p_name AS query, CAST(0 AS BIGINT) AS chunks FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT chunk_id, sha256(chunk_id), count(*) FROM (SELECT 'lec' || label AS chunk_id FROM embeddings) GROUP BY 1, 2""")
def kept_files(fx):
    """Topic files and the kept index, written, read back and checked against what they were made of."""
    folder = new_folder(fx.spark)
    # every fourth line is a comment or blank
    line = F.expr("case when p_partkey % 8 = 0 then concat('# ', p_name) when p_partkey % 4 = 0 then '  ' else concat('  p', p_partkey, ' ') end")
    fx.table("part").select(line.alias("value")).write.text(f"{folder}/topics")
    names = fx.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("topic"), F.col("p_name").alias("query"))
    topics = files.topics(fx.spark, f"{folder}/topics").drop("query").join(names, "topic").select("topic", "query", "chunks")
    index = retrieval.with_norm(fx.chunk.select("chunk_id", "embedding"))
    files.write_index(index, "f1", f"{folder}/index")
    if files.read_index(fx.spark, f"{folder}/index", "f2", index) is not None:
        raise AssertionError("an index of another fingerprint was taken")
    kept = files.read_index(fx.spark, f"{folder}/index", "f1", index)
    lecture = F.substring_index("chunk_id", "/", 1)
    return topics.union(kept.groupBy(lecture.alias("l")).agg(F.count(F.lit(1)).alias("n")).select("l", F.sha2(F.col("l").cast("binary"), 256), "n"))
