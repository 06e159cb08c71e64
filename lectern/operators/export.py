"""Export operators: public and hidden views of questions, item groups, material manifests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..scratch import written
from .ranks import ranked

# Fixed values.
GRANULARITIES = ("topic", "configuration_topic", "configuration", "run")
CONDITIONS = ("all", "accepted", "rejected", "split")


def question_ids(questions: DataFrame, order: str = "q_index") -> DataFrame:
    """``question_id``: ``<quiz>-q<n>``, from 0 in order."""
    n = F.row_number().over(Window.partitionBy("quiz_id").orderBy(order)) - 1
    return questions.withColumn("question_id", F.concat(F.col("quiz_id").cast("string"), F.lit("-q"), n.cast("string")))


def public_questions(questions: DataFrame, quizzes: DataFrame, requests: DataFrame, competencies: DataFrame) -> DataFrame:
    """What readers may see: no explanation, no source, no generator. Quizzes of unknown requests are dropped.

    The objective is that of the question's competency, or the request's joined ones where it names none.
    """
    known = quizzes.join(requests.select("request_key", "course_key", "language", F.col("objectives").alias("request_objectives"), "bloom"), "request_key")
    c = competencies.select("course_key", F.col("competency_key"), F.col("title").alias("competency"), t.objective("title", "description").alias("own_objective"), F.col("taxonomy"))
    out = question_ids(questions).join(known, "quiz_id").join(c, ["course_key", "competency_key"], "left")
    return out.select(
        "quiz_id", "question_id", F.col("text").alias("question"), t.domain_of("course_key").alias("domain"), "language", "competency",
        F.coalesce("own_objective", "request_objectives").alias("learning_objective"), F.coalesce("taxonomy", "bloom").alias("bloom_intended"),
    )


def hidden_questions(questions: DataFrame, quizzes: DataFrame) -> DataFrame:
    """The sidecar by the same ids: origin, generator, explanation and decision where there are any."""
    out = question_ids(questions).join(quizzes.select("quiz_id", F.col("configuration_id").alias("generator_id")), "quiz_id")
    keep = [c for c in ("explanation", "decision") if c in questions.columns]
    return out.select("quiz_id", "question_id", F.lit("ai").alias("provenance"), "generator_id", *keep)


def correct_answer(kind: Column, options: Column) -> Column:
    """Texts of the correct options; the first alone unless several may be right."""
    texts = F.transform(F.filter(options, lambda o: o["correct"]), lambda o: o["text"])
    return F.when(kind == "multiple-choice", texts).otherwise(F.slice(texts, 1, 1))


def group_key(granularity: str, topic="topic_key", configuration="configuration_id", run="run_id") -> Column:
    return {"topic": F.col(topic), "configuration_topic": F.concat(F.col(configuration), F.lit("__"), F.col(topic)), "configuration": F.col(configuration), "run": F.col(run)}[granularity]


def item_groups(items: DataFrame, granularity: str = "topic", condition: str = "all") -> DataFrame:
    """One row per file to write: id, items, distinct sorted configurations, runs and topics, the difficulty if all share
    one, the lecture if all grounding shares one (else ``.``). Empty groups have no row.

    ``items(configuration_id, run_id, topic_key, accepted, requested_difficulty, lectures array)``.
    """
    ok = F.coalesce(F.col("accepted"), F.lit(False))
    label = {"all": F.lit("all"), "accepted": F.when(ok, "accepted"), "rejected": F.when(~ok, "rejected"), "split": F.when(ok, "accepted").otherwise("rejected")}[condition]
    put = items.withColumn("group_key", group_key(granularity)).withColumn("condition", label).where("condition is not null")
    band = t.difficulty_band("requested_difficulty")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    # all share one where the first and the last are the same
    first, last = (f(F.filter("lectures", lambda x: x != "")) for f in (F.array_min, F.array_max))
    out = put.groupBy("group_key", "condition").agg(
        F.count(F.lit(1)).alias("item_count"), names("configuration_id").alias("configuration_ids"), names("run_id").alias("run_ids"), names("topic_key").alias("topics"),
        F.when(F.min(band) == F.max(band), F.min(band)).alias("difficulty"), F.min(first).alias("l0"), F.max(last).alias("l1"),
    )
    source = F.when(F.col("l0") == F.col("l1"), F.col("l0")).otherwise(".")
    return out.withColumn("source_material", source).withColumn("quiz_id", F.concat(t.slug_file("group_key"), F.lit("__"), F.col("condition"))).drop("l0", "l1")


def item_ids(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``question_id``: ``q1``, ``q2``, ... within a group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return items.withColumn("question_id", F.concat(F.lit("q"), n.cast("string")))


def with_competency(items: DataFrame, competencies: DataFrame) -> DataFrame:
    """Items with the competency whose title is their topic: the first declared one (``ord``), null without any."""
    first = competencies.groupBy("title").agg(F.min_by(F.struct("competency_key", "taxonomy"), "ord").alias("c"))
    named = first.select(F.col("title").alias("topic_key"), F.col("c.competency_key").alias("titled_key"), F.col("c.taxonomy").alias("taxonomy"))
    return items.join(named, "topic_key", "left")


def material_manifest(requests: DataFrame, links: DataFrame) -> DataFrame:
    """``path`` (course/competency) and its distinct sorted documents, for requests of a single competency."""
    one = requests.where(F.size("competency_keys") == 1).select("course_key", F.element_at("competency_keys", 1).alias("competency_key")).distinct()
    docs = one.join(links, ["course_key", "competency_key"]).groupBy("course_key", "competency_key").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    return docs.select(F.concat_ws("/", "course_key", "competency_key").alias("path"), "documents")


def manifest_diff(declared: DataFrame, found: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """``missing``, ``extra`` or ``differs`` of each file that isn't as declared."""
    d, f = declared.select(key, F.col(value).alias("d")), found.select(key, F.col(value).alias("f"))
    both = d.join(f, key, "full")
    return both.select(key, F.when(F.col("f").isNull(), "missing").when(F.col("d").isNull(), "extra").when(F.col("d") != F.col("f"), "differs").alias("status")).where("status is not null")


def render_options(options) -> Column:
    line = lambda o: F.concat(F.lit("- ["), F.when(o["correct"], "correct").otherwise("wrong"), F.lit("] "), o["text"])
    return F.array_join(F.transform(t.col(options), line), "\n")


def render_candidate(id_, title, question, options) -> Column:
    return F.concat(F.lit("["), t.col(id_).cast("string"), F.lit("] "), t.col(title), F.lit("\n"), t.col(question), F.lit("\n"), render_options(options))


#: Digests that are folded into one.
FAN = 1024


def fingerprint(rows: DataFrame, order: list[str], fields: list[str], fan: int = FAN) -> DataFrame:
    """``fingerprint, rows``: a hash tree over the rows in order. A leaf is the SHA-256 of a row's fields; each ``fan`` neighbours,
    joined by line feeds, give a digest of the level above, until one is left. So up to ``fan`` rows it is one hash over all
    leaves; more are folded by many tasks, and no group has more than ``fan`` digests. No rows give the hash of nothing."""
    leaf = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(f).cast("string"), F.lit("\x01")) for f in fields]), 256)
    level = ranked(rows.select(*order, leaf.alias("h")), [], [*order, "h"]).select((F.col("__n") - 1).alias("n"), "h")
    total = left = level.count()
    while left:
        digests = F.array_sort(F.collect_list(F.struct("n", "h")))["h"]
        level = level.groupBy((F.floor(F.col("n") / fan)).alias("m")).agg(F.sha2(F.array_join(digests, "\n").cast("binary"), 256).alias("h")).select(F.col("m").alias("n"), "h")
        left = -(-left // fan) if left > fan else 0
    if not total:
        return rows.sparkSession.createDataFrame([(hashlib.sha256().hexdigest(), 0)], "fingerprint string, rows long")
    return level.select(F.col("h").alias("fingerprint"), F.lit(total).cast("long").alias("rows"))


def retrieval_csv(ranked: DataFrame) -> DataFrame:
    """Rows of the retrieval probe: topic, rank, score with four digits, document, chunk."""
    return ranked.select(F.col("query_id").alias("topic"), "rank", F.format_string("%.4f", "score").alias("score"), t.chunk_document("chunk_id").alias("document"), F.col("chunk_id").alias("chunkId"))


def write_jsonl(records: DataFrame, path: str) -> None:
    """The run log: replaced as a whole, one record a line."""
    records.write.mode("overwrite").json(path)


def write_items_markdown(items: DataFrame, path: str) -> None:
    """One Markdown block per item, in order of topic and index."""
    body = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("question_text"), F.lit("\n\n"), render_options("options"), F.lit("\n"))
    items.orderBy("topic_key", "item_index").select(body.alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; ids quoted, quotes doubled."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_quiz_files(quizzes: DataFrame, path: str) -> None:
    """One folder of JSON per quiz (``quiz_id=...``); ``quizzes(quiz_id, <fields>)``."""
    fields = [c for c in quizzes.columns if c != "quiz_id"]
    quizzes.select("quiz_id", F.to_json(F.struct("quiz_id", *fields)).alias("value")).write.mode("overwrite").partitionBy("quiz_id").text(path)


def join_results(results: DataFrame, sidecar: DataFrame, scope: str = "question") -> DataFrame:
    """Evaluator results with what the sidecar knows, for one scope at a time: per-question results join by question, those of
    whole quizzes by quiz. Results that don't apply (they carry full marks) are left out first."""
    ok = results.where(F.col("applicable"))
    if scope == "question":
        return ok.where(F.col("question_id").isNotNull()).join(sidecar, ["quiz_id", "question_id"])
    quizzes = sidecar.select("quiz_id", "generator_id").distinct()
    return ok.where(F.col("question_id").isNull()).drop("question_id").join(quizzes, "quiz_id")


def score_summary(joined: DataFrame) -> DataFrame:
    """Mean score and number of results per generator and metric."""
    return joined.groupBy("generator_id", "metric_name").agg(F.count(F.lit(1)).alias("results"), F.avg("score").alias("mean_score"))


def sweep_export(quizzes: DataFrame, questions: DataFrame, requests: DataFrame, competencies: DataFrame, path: str) -> None:
    """Write an experiment's evaluator input: ``quizzes`` (public), ``sidecars`` (hidden, by the same ids), ``instructions``.

    Quizzes of unknown requests and quizzes without a question are left out of all three.
    """
    public = public_questions(questions, quizzes, requests, competencies)
    each = F.array_sort(F.collect_list(F.struct("question_id", "question", "domain", "language", "competency", "learning_objective", "bloom_intended")))
    shown = public.groupBy("quiz_id").agg(each.alias("questions"))
    write_quiz_files(shown, f"{path}/quizzes")
    hidden = hidden_questions(questions, quizzes).join(shown.select("quiz_id"), "quiz_id", "left_semi")
    rest = [c for c in hidden.columns if c != "quiz_id"]
    write_quiz_files(hidden.groupBy("quiz_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("questions")), f"{path}/sidecars")
    asked = quizzes.join(requests, "request_key").join(shown.select("quiz_id"), "quiz_id", "left_semi")
    write_quiz_files(asked.select("quiz_id", t.language_name("language").alias("language"), "course_key", F.col("objectives").alias("learning_objectives")), f"{path}/instructions")


def sweep_files(quizzes: DataFrame, questions: DataFrame, requests: DataFrame, competencies: DataFrame) -> DataFrame:
    """``file, content`` of an experiment's whole evaluator input, to be written as one export: ``quizzes/<id>.json`` (public),
    ``sidecars/<id>.json`` (hidden, by the same ids) and ``instructions/<id>.json``. Quizzes of unknown requests and quizzes
    without a question are in none of them."""
    public = public_questions(questions, quizzes, requests, competencies)
    each = F.array_sort(F.collect_list(F.struct("question_id", "question", "domain", "language", "competency", "learning_objective", "bloom_intended")))
    shown = written(public.groupBy("quiz_id").agg(each.alias("questions")))
    hidden = hidden_questions(questions, quizzes)
    aside = F.array_sort(F.collect_list(F.struct(*[c for c in hidden.columns if c != "quiz_id"])))
    hidden = hidden.join(shown.select("quiz_id"), "quiz_id", "left_semi").groupBy("quiz_id").agg(aside.alias("questions"))
    asked = quizzes.join(requests, "request_key").join(shown.select("quiz_id"), "quiz_id", "left_semi")
    asked = asked.select("quiz_id", t.language_name("language").alias("language"), "course_key", F.col("objectives").alias("learning_objectives"))

    def put(folder: str, rows: DataFrame) -> DataFrame:
        file = F.concat(F.lit(f"{folder}/"), F.col("quiz_id").cast("string"), F.lit(".json"))
        return rows.select(file.alias("file"), F.to_json(F.struct(*rows.columns)).alias("content"))

    return put("quizzes", shown).union(put("sidecars", hidden)).union(put("instructions", asked))


def item_lines(items: DataFrame) -> DataFrame:
    """``file, topic_key, item_index, line`` of the Markdown view of a run, a block an item: for an export of lines ordered by
    topic and index."""
    body = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("question_text"), F.lit("\n\n"), render_options("options"), F.lit("\n"))
    return items.select(F.concat(F.lit("runs/"), "run_id", F.lit("/items.md")).alias("file"), "topic_key", "item_index", body.alias("line"))


def csv_line(*cells) -> Column:
    """Cells quoted, quotes doubled, a null empty."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(t.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *map(quoted, cells))


#: The evaluator's metrics with their versions, and those that need more than single quizzes or the material.
METRICS = {
    "accuracy": "1.2", "answer_key_correctness": "1.0", "objective_alignment": "1.0", "cognitive_level": "1.0", "clarity": "2.0", "distractor_quality": "2.0",
    "absence_of_cueing": "1.0", "grammatical_correctness": "2.1", "difficulty": "1.2", "coverage": "1.6", "homogeneous_options": "2.0",
    "cross_item_redundancy": "1.0", "difficulty_spread": "1.0", "objective_balance": "1.0",
}
OFF = ("coverage", "cross_item_redundancy", "difficulty_spread", "objective_balance")


def evaluator_config(name: str, metrics: dict[str, str] | None = None, disabled: tuple[str, ...] = OFF, runs: int = 3) -> str:
    """An evaluator's configuration in YAML: one independent judge, the metrics with their versions, the folders of an export."""
    import yaml

    root = {
        "benchmark": {"name": name, "version": "1.0.0", "runs": runs},
        "evaluators": {"independent_judge": {"provider": "openai_compatible", "model": "<a model that made or judged none of these questions>", "temperature": 1.0, "max_tokens": 8000}},
        "metrics": [{"name": m, "version": v, "evaluators": ["independent_judge"], "enabled": m not in disabled} for m, v in (metrics or METRICS).items()],
        "inputs": {"quiz_directory": "quizzes", "source_directory": "<path to the course material>", "instructions_directory": "instructions"},
        "outputs": {"results_directory": "results", "aggregate": True},
    }
    return yaml.safe_dump(root, sort_keys=False)
