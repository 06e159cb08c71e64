"""The registered queries: operators applied to the adapter views. Numbers in money and means are rounded to six digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..functions import text as t
from ..operators import corpus, export, pool, quality, reports, retrieval, store
from ..schemas import DIFFICULTIES, QUESTION_TYPES

GPU_LOW, GPU_HIGH = 0.08, 1.20
GATE = ("FACTUAL_ERROR", "AMBIGUOUS_CORRECT_ANSWER", "OFF_TOPIC")
CHUNK_TARGET, CHUNK_MOST = 50, 120
TOP_K = 12

QUERIES: dict = {}


def query(f):
    """Register ``f(fx)`` as a query of its name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
    return f


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """To six digits, and whole numbers as longs."""
    out = df.withColumns({c: F.round(c, 6) for c in cols})
    return out.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "decimal(38,0)") else F.col(c) for c, kind in out.dtypes])


def _usable(fx):
    return corpus.usable_pages(fx.page.select("document_id", "lecture", "unit", "page_number", "text"))


def _decided(fx):
    """Items with their decision under the default gate."""
    return fx.item.join(quality.decide(fx.severity, 0.7).select("item_id", "accepted"), "item_id", "left")


def _top(fx, k=TOP_K):
    index = fx.chunk
    queries = index.where("chunk_ord % 50 = 0").select(F.col("chunk_ord").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.top_k(queries, index, k)


@query
def doc_extraction_report(fx):
    return corpus.document_report(fx.page.select("document_id", "lecture", "unit", "page_number", "text"))


@query
def doc_language_detect(fx):
    s = corpus.language_samples(_usable(fx))
    return s.withColumn("language", t.language_of("german", "english"))


@query
def page_chunks(fx):
    c = corpus.chunks(_usable(fx), CHUNK_TARGET, CHUNK_MOST)
    return rounded(c.select("chunk_id", "document_id", "first_page", "last_page", F.length("text").alias("n_chars")))


@query
def topic_catalogue(fx):
    return corpus.topics(corpus.chunks(_usable(fx), CHUNK_TARGET, CHUNK_MOST))


@query
def cosine_topk(fx):
    return rounded(_top(fx).select("query_id", "chunk_id", "rank", "score"), "score")


@query
def gate_decisions(fx):
    return rounded(quality.decide(fx.severity, 0.7, GATE), "aggregate_score", "mean_severity")


RAW_SCORES = """
SELECT doc_id AS item_id, ord,
 CASE ord WHEN 0 THEN ' factual-error ' WHEN 1 THEN 'Ambiguous Correct Answer' WHEN 2 THEN 'OFF_TOPIC' WHEN 3 THEN CASE WHEN doc_id % 7 = 0 THEN 'nonsense' ELSE 'near duplicate' END
   WHEN 4 THEN 'ill_formed-distractors' WHEN 5 THEN 'off topic' ELSE 'difficulty mismatch' END AS mode,
 CASE WHEN (doc_id + ord) % 5 = 0 THEN NULL ELSE ((doc_id * 7 + ord * 3) % 16) / 10e0 - 0.2e0 END AS severity,
 CASE (doc_id + ord) % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS triggered
FROM labels CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) o"""


@query
def verdict_normalise(fx):
    raw = fx.spark.sql(RAW_SCORES.replace("FROM labels", "FROM {labels}"), labels=fx.table("labels"))
    return rounded(quality.normalise_verdicts(raw, "GENERAL", ["item_id"]), "severity")


@query
def redecide_changes(fx):
    items = fx.item.where("state = 'FILTERED'").join(fx.run, "run_id", "left_semi").select("item_id")
    s = fx.severity.join(items, "item_id", "left_semi")
    r = quality.redecide(s, quality.decide(s, 0.8), 0.6, GATE)
    return r.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("changed").cast("long")).alias("changed"), F.sum(F.col("accepted").cast("long")).alias("accepted"))


@query
def incremental_enqueue(fx):
    docs = fx.table("documents").select("doc_id", F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string")).alias("document"), F.sha2("text", 256).alias("content_hash"))
    before = docs.where("doc_id % 97 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 97 == 1, "x").otherwise(F.col("content_hash")))
    changed = pool.changed_documents(docs, before)
    retrieved = docs.select(F.concat(F.lit("c"), (F.col("doc_id") % 97 % 16).cast("string")).alias("competency_key"), F.concat("document", F.lit(".pdf#p1-2")).alias("chunk_id"))
    items = fx.item.where("run_id = 'run-1' and state = 'PENDING' and competency_key <> 'c3'")
    cells = fx.item.select("competency_key", "language", "difficulty_band").distinct().withColumn("cell_key", F.concat_ws("|", "competency_key", "language", "difficulty_band"))
    n = items.groupBy(F.concat_ws("|", "competency_key", "language", "difficulty_band").alias("cell_key")).agg(F.count(F.lit(1)).alias("n"))
    sized = pool.targets(cells, n, pool.touched(retrieved, changed), 20, True)
    new = pool.new_items(sized).groupBy("cell_key").agg(F.min("item_index").alias("first_index"), F.count(F.lit(1)).alias("new_items"))
    return sized.join(new, "cell_key", "left").select("cell_key", "existing", "target", "first_index", F.coalesce("new_items", F.lit(0)).alias("new_items"))


@query
def pool_grid(fx):
    s = fx.spark
    comps = fx.table("supplier").selectExpr("concat('n', s_nationkey) as course_key", "concat('c', s_suppkey) as competency_key", "s_suppkey as ord")
    side = lambda name, xs: s.createDataFrame(list(enumerate(xs)), f"ord int, {name} string")
    g = pool.grid(comps, side("language", ["de", "en"]), side("question_type", QUESTION_TYPES), side("difficulty_band", list(DIFFICULTIES)))
    return g.select("position", "cell_key", t.cell_of("cell_key")["question_type"].alias("question_type"))


@query
def items_missing_verdict(fx):
    items = fx.item.where("configuration_id = 'pool|local' and state in ('GENERATED', 'FILTERING', 'FILTERED')")
    return pool.missing_verdicts(items, fx.verdict, "judge-cloud").select("item_id", "competency_key", "state")


@query
def pool_candidates_asof(fx):
    c = pool.candidates(fx.item, fx.verdict, "judge-local", {"competency_key": "c2", "language": "en"}, "1996-06-30 00:00:00")
    return c.select("item_id", "difficulty_band", "state")


@query
def pool_judge_matrix(fx):
    m = pool.judge_matrix(fx.item.where("configuration_id = 'pool|local'"), fx.verdict)
    return m.select("item_id", F.col("judges")["judge-local"].alias("judge_local"), F.col("judges")["judge-cloud"].alias("judge_cloud"))


@query
def browse_items(fx):
    b = store.browse(_decided(fx).where("state = 'FILTERED'"), fx.call, 100, run_id="run-2", accepted=True)
    return b.select("item_id", "competency_key", "attempts")


@query
def state_progress(fx):
    return reports.progress(fx.item, ["run_id"])


@query
def state_counts(fx):
    return reports.state_counts(fx.item, ["run_id"])


@query
def quizzes_by_approach(fx):
    return store.by_approach(fx.item, "two-phase").groupBy("run_id", "configuration_id").agg(F.count(F.lit(1)).alias("quizzes"))


@query
def quiz_run_recency(fx):
    return reports.run_recency(fx.item.withColumn("created_at", F.col("updated_at"))).select("position", "run_id", "quizzes")


# a quiz is what its latest call left
STORED_QUIZZES = """
SELECT configuration_id, request_key, repetition, max_by(questions, call_id) AS questions, max_by(bad, call_id) AS bad FROM (
 SELECT call_id, CASE call_id % 2 WHEN 0 THEN 'agentic|local|local|local' ELSE 'two-phase|local|cloud|cloud' END AS configuration_id,
  concat('r', CAST((call_id % 8 - call_id % 2) / 2 + 1 AS INTEGER)) AS request_key,
  CAST((call_id % 24 - call_id % 8) / 8 + 1 AS INTEGER) AS repetition, CASE WHEN outcome = 'success' AND call_id % 24 >= 8 THEN 3 ELSE 0 END AS questions,
  CASE WHEN failure_category IN ('TIMEOUT', 'TRANSPORT', 'RATE_LIMIT') OR call_id % 5 = 0 THEN 1 ELSE 0 END AS bad FROM fx_call) x GROUP BY 1, 2, 3"""


def _stored(fx):
    q = fx.spark.sql(STORED_QUIZZES.replace("FROM fx_call", "FROM {calls}"), calls=fx.call)
    categories = F.when(F.col("bad") == 1, F.array(F.lit("TIMEOUT"))).otherwise(F.array(F.lit(None).cast("string")))
    return q.withColumn("final", store.final_quiz(F.col("questions"), categories))


@query
def sweep_worklist(fx):
    w = store.work_list(fx.configuration.select("configuration_id"), fx.request.select("request_key"), 3, _stored(fx).where("final"))
    return rounded(w.select("configuration_id", "request_key", "repetition"))


@query
def sweep_status(fx):
    more = fx.spark.sql("select 'agentic|cloud|cloud|cloud' as configuration_id")
    return store.sweep_status(fx.configuration.select("configuration_id").union(more), _stored(fx))


def _options(fx):
    o = [F.struct(F.col(f"opt{i}").alias("text"), F.col(f"c{i}").alias("correct")) for i in (1, 2, 3, 4)]
    return fx.mcq.withColumn("options", F.filter(F.array(*o), lambda x: x["text"].isNotNull()))


@query
def item_defects(fx):
    m = _options(fx)
    return m.select("item_id", "type", quality.defect_of(F.col("type"), F.col("title"), F.col("question_text"), F.col("options")).alias("defect"))


@query
def defect_histogram(fx):
    m = _options(fx).withColumn("defect", quality.quiz_defect_of(F.lit(True), F.col("type"), F.array(F.lit("single-choice"), F.lit("multiple-choice")), F.col("title"), F.col("question_text"), F.col("options")))
    return quality.defect_histogram(m, ["type"])


@query
def item_length_stats(fx):
    m = _options(fx)
    return rounded(m.select("item_id", quality.length_stats("title", "question_text", F.lit(None).cast("string"), "options").alias("s")).select("item_id", "s.*"))


@query
def call_failure_classes(fx):
    return fx.call.groupBy(F.coalesce("failure_category", F.lit("none")).alias("category"), t.retryable("failure_category").alias("retryable")).agg(F.count(F.lit(1)).alias("calls"))


@query
def http_classes(fx):
    s = fx.table("events").select(F.col("event_id").alias("call_id"), (F.col("event_id") % 7 + 1).alias("attempt"), (F.lit(395) + F.col("user_id") * 7 % 130).alias("status"))
    return s.withColumns({"kind": t.http_kind("status"), "retryable": t.retryable(t.http_kind("status")), "backoff_ms": t.backoff_ms("attempt")})


@query
def call_costs(fx):
    return rounded(reports.cost(fx.call, fx.price, ["stage"], GPU_LOW, GPU_HIGH), "low_eur", "high_eur")


@query
def cost_per_configuration(fx):
    c = reports.cost_per_configuration(_decided(fx), fx.run, fx.call, fx.price, GPU_LOW, GPU_HIGH)
    return rounded(c, "low_eur", "high_eur", "per_item_low", "per_item_high", "per_accepted_low", "per_accepted_high")


def _quizzes(fx):
    return fx.item.where("state = 'FILTERED' and configuration_id <> 'pool|local'")


def _pools(fx):
    own = fx.item.where("configuration_id = 'pool|local' and state in ('FILTERED', 'FAILED_GENERATION', 'FAILED_FILTER')").select("item_id")
    calls = fx.call.join(own, "item_id", "left_semi").withColumn("generator", F.lit("local"))
    return reports.pool_cost(calls, fx.call.where("stage = 'filter'"), fx.configuration.where("approach = 'two-phase'").select("generator").distinct(), fx.price, GPU_LOW, GPU_HIGH)


@query
def pool_costs(fx):
    return rounded(_pools(fx), "low_eur", "high_eur")


@query
def sweep_amortisation(fx):
    q = _quizzes(fx)
    calls = fx.call.join(q.select("item_id", "configuration_id"), "item_id")
    a = reports.amortisation(fx.configuration, reports.quiz_cost(q, calls, fx.price, GPU_LOW, GPU_HIGH), _pools(fx))
    return rounded(a, "agentic_mid", "two_phase_mid", "pool_mid")


@query
def quiz_costs(fx):
    q = _quizzes(fx)
    calls = fx.call.join(q.select("item_id", "configuration_id"), "item_id")
    return rounded(reports.quiz_cost(q, calls, fx.price, GPU_LOW, GPU_HIGH), "low_eur", "high_eur", "mid_per_quiz")


@query
def phase_usage(fx):
    return reports.phase_usage(fx.call.join(_quizzes(fx).select("item_id", "configuration_id"), "item_id"))


@query
def selection_ratio(fx):
    q = fx.item.select("configuration_id", (F.col("item_id") % 5).alias("questions"), F.when(F.col("configuration_id").startswith("two"), F.col("item_id") % 40).otherwise(0).alias("candidate_count"))
    return rounded(reports.selection_ratio(q), "selection_ratio")


COMPETENCIES = """
SELECT 'EIDI' AS course_key, 'c0' AS competency_key, 'Arrays' AS title, concat('- You index.', chr(10), ' ', chr(10), '- You sort.') AS description, 'APPLY' AS taxonomy
UNION ALL SELECT 'EIDI', 'c1', 'Loops', NULL, 'UNDERSTAND' UNION ALL SELECT 'PSE', 'c2', 'Tests', 'You test - always.', 'ANALYZE' UNION ALL SELECT 'OR', 'c3', 'Duals', '  ', 'REMEMBER'"""
REQUESTS = """
SELECT 'r1' AS request_key, 'EIDI' AS course_key, 'de' AS language, 'joined one' AS objectives, 'APPLY' AS bloom
UNION ALL SELECT 'r2', 'PSE', 'en', 'joined two', 'CREATE' UNION ALL SELECT 'r3', 'OR', 'en', 'joined three', 'UNDERSTAND'"""


def _quiz_requests(fx):
    return fx.question.select("quiz_id").distinct().select("quiz_id", F.concat(F.lit("r"), (F.col("quiz_id") % 4 + 1).cast("string")).alias("request_key"), F.lit("two-phase|local|cloud|cloud").alias("configuration_id"))


@query
def public_questions(fx):
    q = fx.question.withColumn("competency_key", F.concat(F.lit("c"), (F.col("quiz_id") % 5).cast("string")))
    return export.public_questions(q, _quiz_requests(fx), fx.spark.sql(REQUESTS), fx.spark.sql(COMPETENCIES))


@query
def hidden_questions(fx):
    return export.hidden_questions(fx.question, _quiz_requests(fx))


@query
def item_export_groups(fx):
    items = _decided(fx).where("state = 'FILTERED'").join(fx.run, "run_id", "left_semi").withColumn("topic_key", F.col("competency_key"))
    lecture = F.when(F.col("requested_difficulty") > 20, F.concat(F.lit("lec"), F.substring("competency_key", 2, 2))).otherwise("")
    items = items.withColumn("lectures", F.array(lecture))
    out = export.item_groups(items, "configuration_topic", "split").withColumn("granularity", F.lit("configuration_topic"))
    return out.unionByName(export.item_groups(items, "run", "accepted").withColumn("granularity", F.lit("run")))


@query
def threshold_sweep(fx):
    return reports.threshold_sweep(fx.severity)


def _composed(fx):
    c = retrieval.composition(fx.chunk.withColumn("slot", F.col("chunk_ord") % 50), ["slot"])
    items = _decided(fx).where("state = 'FILTERED'").withColumn("slot", F.col("item_id") % 60)
    return items.join(c.select("slot", "solution_fraction"), "slot", "left").withColumn("bucket", reports.bucket_of(F.col("solution_fraction")))


MEANS = [f"mean_{m}" for m in ("factual_error", "ambiguous_correct_answer", "off_topic", "near_duplicate", "ill_formed_distractors", "competency_mismatch", "difficulty_mismatch", "instruction_violation")]


@query
def composition_crosstab(fx):
    return rounded(reports.crosstab(_composed(fx), fx.severity, "bucket", [b[0] for b in reports.BUCKETS]), *MEANS)


@query
def difficulty_crosstab(fx):
    return rounded(reports.crosstab(_decided(fx).where("state = 'FILTERED'"), fx.severity, "requested_difficulty"), *MEANS)


@query
def failure_summary(fx):
    return reports.failures(fx.item, fx.call)


@query
def failure_totals(fx):
    return rounded(reports.failure_totals(fx.item, fx.call), "failed_call_rate")


@query
def grounding_budget(fx):
    s = _top(fx).withColumn("tokens", (F.lit(100) + F.col("chunk_ord") * 37 % 400).cast("long")).withColumn("place", F.col("rank"))
    kept = retrieval.within_budget(s, 2000, ["query_id"])
    tokens = kept.groupBy("query_id").agg(F.max("tokens_so_far").alias("tokens"))
    return rounded(retrieval.composition(kept, ["query_id"]).join(tokens, "query_id"), "solution_fraction")


@query
def interleave_round_robin(fx):
    lists = _top(fx).withColumn("panel", F.expr("query_id div 150")).withColumn("position", F.expr("query_id div 50 % 3"))
    return retrieval.interleave(lists, ["panel"]).select("panel", "place", "chunk_id")


@query
def subsection_partition(fx):
    c = fx.chunk.withColumn("lecture", t.chunk_lecture("chunk_id"))
    return retrieval.subsections(c, 4, ["lecture"]).select("chunk_id", "lecture", "section")


@query
def batch_plan(fx):
    items = fx.item.where("state = 'PENDING'").select("item_id", "competency_key", "language")
    return pool.batches(items, 12, ["competency_key", "language"], ["item_id"])


@query
def enqueue_ladder(fx):
    topics = fx.table("supplier").select(F.col("s_suppkey").alias("position"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("topic"))
    e = pool.enqueue_round_robin(topics, fx.table("orders").count())
    return rounded(e.select("i", "topic", "item_index", pool.ladder("item_index", [20, 40, 60, 80]).alias("level")))


CHOICES = "SELECT user_id % 20 AS request, event_id AS pos, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 60 END AS id FROM events"


@query
def selection_cleanup(fx):
    chosen = fx.spark.sql(CHOICES.replace("FROM events", "FROM {events}"), events=fx.table("events"))
    ids = fx.spark.range(50)
    known = fx.spark.range(20).withColumnRenamed("id", "request").crossJoin(F.broadcast(ids)).where("(id + request) % 3 <> 0")
    return quality.clean_selection(chosen, known, 10, ["request"]).select("request", "id", "rank")


@query
def shortlist_batches(fx):
    c = fx.item.where("state = 'FILTERED'").select("competency_key", F.col("item_id").alias("id"))
    return quality.shortlist_batches(c, 40, ["competency_key"])


@query
def agentic_acceptance(fx):
    q = fx.question.withColumn("would_accept", (F.col("quiz_id") + F.col("q_index")) % 3 != 0)
    return quality.accept_in_order(q, 2, ["quiz_id"], ["q_index"]).select("quiz_id", "q_index", "status")


@query
def agentic_rounds(fx):
    r = fx.question.groupBy("quiz_id", F.expr("q_index div 2").alias("round")).agg(F.sum(((F.col("quiz_id") + F.col("q_index")) % 3 == 0).cast("long")).alias("accepted"))
    return quality.rounds_run(r.withColumn("failed", (F.col("quiz_id") + F.col("round")) % 4 == 0), ["quiz_id"]).select("quiz_id", "round", "accepted")


@query
def slug_variants(fx):
    names = fx.table("documents").select("doc_id", F.col("text").alias("name"))
    return names.select("doc_id", t.slug_letters("name").alias("letters"), t.slug_ascii("name").alias("ascii"), t.slug_file("name").alias("file"), t.slug_latin("name").alias("latin"))


UNITS = "01 Intro__to  X/2 Basics.pdf|03_Graphs/CE 1 Exercises.PDF|loose.pdf|04 LP/Tutorial 2 Solution.pdf|04 LP/Übungsaufgaben.pdf|a/b/7_deck.pdf|x/notes.txt|05  Simplex/Central exercise 3.pdf"


@query
def unit_roles(fx):
    e = F.element_at(F.split(F.lit(UNITS), "[|]"), (F.col("p_partkey") % 8 + 1).cast("int"))
    of = F.col("p_partkey").cast("string")
    lecture = F.substring_index("e", "/", 1)
    named = F.when(F.instr("e", "/") > 0, F.concat(lecture, F.lit(" "), of, F.expr("substr(e, length(substring_index(e, '/', 1)) + 1)"))).otherwise(F.concat(of, F.lit(" "), "e"))
    d = fx.table("part").withColumn("e", e).select(named.alias("document_id"))
    return d.select("document_id", t.lecture_name("document_id").alias("lecture"), t.unit_name("document_id").alias("unit"), t.role_of(t.unit_name("document_id")).alias("role"), t.to_query(t.lecture_name("document_id")).alias("query"))


@query
def chunk_id_parts(fx):
    c = fx.chunk
    return rounded(c.select("chunk_id", t.chunk_document("chunk_id").alias("document"), t.chunk_first_page("chunk_id").alias("first_page"), t.chunk_lecture("chunk_id").alias("lecture"), t.page_range("chunk_ord", F.col("chunk_ord") + F.col("chunk_ord") % 2).alias("pages")))


@query
def state_transitions(fx):
    i = fx.item.select("item_id", "state", "failure", F.lit(2).alias("generation_attempts"), F.lit(1).alias("filter_attempts"))
    revived = store.revive(i).select("item_id", F.col("state").alias("revived_state"), F.col("generation_attempts").alias("revived_generation"), F.col("filter_attempts").alias("revived_filter"))
    stage = F.when(F.col("item_id") % 2 == 0, "GENERATING").otherwise("FILTERING")
    out = i.withColumn("released", store.released(F.col("state"))).withColumn("after_failure", store.failure_state(stage, F.col("item_id") % 3 == 0)).withColumn("retry", store.may_retry(F.col("filter_attempts"), 3, F.col("failure")))
    return rounded(out.join(revived, "item_id", "left").drop("generation_attempts", "filter_attempts", "failure", "state"))


@query
def corpus_fingerprint(fx):
    d = fx.table("documents").select(F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    return export.fingerprint(d, ["path"], ["path", "sha256"])


@query
def manifest_diff(fx):
    d = fx.table("documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    found = d.where("doc_id % 11 <> 0").withColumn("path", F.when(F.col("doc_id") % 13 == 0, F.concat("path", F.lit("b"))).otherwise(F.col("path"))).withColumn("sha256", F.when(F.col("doc_id") % 17 == 0, "x").otherwise(F.col("sha256")))
    return export.manifest_diff(d, found)


@query
def material_manifest(fx):
    r = fx.request.select("course_key", F.when(F.col("request_key") == "r3", F.array("competency_key", F.lit("c9"))).otherwise(F.array("competency_key")).alias("competency_keys"))
    links = fx.item.select(F.when(F.col("language") == "de", "EIDI").otherwise("PSE").alias("course_key"), "competency_key", F.concat(F.lit("d"), (F.col("item_id") % 9).cast("string")).alias("document_id"))
    return export.material_manifest(r, links).withColumn("documents", F.concat_ws(",", "documents"))


@query
def competency_topics(fx):
    links = fx.item.select("competency_key", F.concat(F.lit("lec"), (F.col("item_id") % 12).cast("string"), F.lit("/deck"), (F.col("item_id") % 7).cast("string"), F.lit(".pdf")).alias("document_id"))
    per = fx.chunk.select(t.chunk_document("chunk_id").alias("document_id"))
    return corpus.competency_topics(fx.item.select("competency_key").distinct(), links, per)


@query
def attempt_totals(fx):
    return reports.attempt_totals(fx.call.select("item_id", (F.col("outcome") == "success").alias("correct")))


@query
def lecture_listing(fx):
    return corpus.lecture_listing(fx.page.select("document_id").distinct())


@query
def next_claims(fx):
    items = fx.item.where("run_id = 'run-3'").withColumn("topic_key", F.col("competency_key")).withColumn("item_index", F.col("item_id"))
    return store.next_claim(items, 20).select("item_id", "state")


TITLES = """
SELECT 0 AS ord, 'c1' AS title, 'k0' AS competency_key, 'APPLY' AS taxonomy UNION ALL SELECT 2, 'c1', 'k2', 'CREATE' UNION ALL SELECT 1, 'c2', 'k1', 'ANALYZE' UNION ALL SELECT 3, 'zz', 'k3', 'APPLY'"""


@query
def items_by_title(fx):
    items = fx.item.where("state = 'FILTERED'").select("item_id", F.col("competency_key").alias("topic_key"))
    return export.with_competency(items, fx.spark.sql(TITLES)).groupBy("topic_key", "titled_key", "taxonomy").agg(F.count(F.lit(1)).alias("items"))


@query
def chunk_roles(fx):
    roles = fx.page.select("document_id").distinct().where("document_id like 'src1%'").withColumn("role", F.lit("TUTORIAL"))
    c = corpus.chunks(_usable(fx), CHUNK_TARGET, CHUNK_MOST, roles)
    return c.groupBy("lecture", "role").agg(F.count(F.lit(1)).alias("chunks"))


@query
def pool_summary(fx):
    return reports.pool_summary(fx.item.where("configuration_id = 'pool|local'"), fx.verdict)


JUDGES = """
SELECT o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'agentic' ELSE 'two-phase' END AS approach, concat('g', CAST(o_custkey AS VARCHAR(20))) AS generator,
 concat('j', CAST(o_orderkey * 7 % 5 AS VARCHAR(20))) AS judge, concat('s', CAST(o_orderkey % 2 AS VARCHAR(20))) AS selector FROM orders"""


def _configurations(fx):
    return fx.spark.sql(JUDGES.replace("FROM orders", "FROM {orders}"), orders=fx.table("orders"))


@query
def judges_of_generators(fx):
    return reports.judges_of_generators(_configurations(fx)).withColumn("judges", F.concat_ws(",", "judges"))


@query
def configuration_counts(fx):
    c = _configurations(fx).withColumn("configuration_id", t.configuration_id("approach", "generator", "judge", "selector"))
    return c.groupBy("configuration_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


RESULTS = """
SELECT quiz_id, CASE WHEN turn % 5 = 4 THEN NULL ELSE concat(CAST(quiz_id AS VARCHAR(20)), '-q', CAST(turn AS VARCHAR(20))) END AS question_id, CASE WHEN turn % 2 = 0 THEN 'accuracy' ELSE 'clarity' END AS metric_name,
 CASE WHEN quiz_id % 4 = 0 THEN 100 ELSE (quiz_id * 7 + turn * 13) % 101 END AS score, quiz_id % 4 <> 0 AS applicable FROM (SELECT conv_id AS quiz_id, turn FROM conversations) c"""


@query
def results_by_generator(fx):
    results = fx.spark.sql(RESULTS.replace("FROM conversations", "FROM {conversations}"), conversations=fx.table("conversations"))
    sidecar = export.hidden_questions(fx.question, _quiz_requests(fx).withColumn("configuration_id", F.concat(F.lit("g"), (F.col("quiz_id") % 3).cast("string"))))
    both = [export.score_summary(export.join_results(results, sidecar, s)).withColumn("scope", F.lit(s)) for s in ("question", "quiz")]
    return rounded(both[0].unionByName(both[1]), "mean_score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["cost_per_configuration"](spark, sf_dir)


TEXTS = """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN ' ' ELSE NULL END AS query, p_type AS title,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('- ', p_name, chr(10), '- ', p_brand) END AS description,
 CASE p_partkey % 3 WHEN 0 THEN 'single-choice' WHEN 1 THEN 'true-false' ELSE 'multiple-choice' END AS type, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'DE' ELSE p_brand END AS code,
 p_brand AS model, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN concat(p_brand, ':q4') WHEN 2 THEN concat(p_brand, 'x') ELSE p_type END AS other,
 concat('a=1', chr(10), 'b=', p_name, '=', p_brand, chr(10), 'none', chr(10), 'a=', p_type) AS manifest FROM part"""


@query
def text_functions(fx):
    p = fx.spark.sql(TEXTS.replace("FROM part", "FROM {part}"), part=fx.table("part"))
    m = t.manifest_lines("manifest")
    return p.select(
        "id", t.retrieval_query("query", "title", "description").alias("retrieval_query"), t.type_name("type").alias("type_name"), t.language_name("code").alias("language"),
        t.same_model("model", "other").alias("same_model"), m["a"].alias("a"), m["b"].alias("b"),
    )


@query
def cost_report(fx):
    c = reports.cost_per_configuration(_decided(fx), fx.run, fx.call, fx.price, GPU_LOW, GPU_HIGH)
    money = ("low_eur", "high_eur", "per_item_low", "per_item_high", "per_accepted_low", "per_accepted_high")
    return reports.cost_table(c.withColumns({m: F.round(m, 6) for m in money}))


@query
def grounding_descriptions(fx):
    s = _top(fx)
    told = retrieval.composition(s, ["query_id"]).join(retrieval.role_counts(s, ["query_id"]), "query_id", "left")
    return told.select("query_id", t.composition_text("counts_by_role", "solution_fraction", "unknown_roles").alias("composition"))


@query
def page_totals(fx):
    items = _decided(fx)
    made = items.where("configuration_id like 'agentic|%' and state = 'FILTERED'")
    whole = reports.export_totals(items, fx.run).select(F.lit("export").alias("page"), "items", "accepted", "configurations")
    return whole.union(reports.generation_totals(made).select(F.col("configuration_id"), "generated", "accepted", F.lit(1).cast("long")))
