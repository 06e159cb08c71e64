"""Command line: one task, then exit. ``python -m lectern.plans.cli <task> ...``"""

from __future__ import annotations

import argparse
import importlib
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, export, quality, reports, retrieval, store
from ..operators.ranks import ranked
from ..sources import config, course_files, exports, files
from . import experiment, readiness


def _session() -> SparkSession:
    return SparkSession.builder.appName("lectern").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _log_frames(spark, path):
    log = files.numbered(files.run_log(spark, path))
    s = log.where("filter_decision is not null").select("item_id", F.explode("filter_decision.mode_verdicts").alias("mode", "v")).select("item_id", "mode", F.col("v.severity").alias("severity"))
    items = log.select("item_id", F.col("filter_decision.accepted").alias("accepted"), F.col("provenance.requested_difficulty").alias("requested_difficulty"), F.col("provenance.grounding_composition.solution_fraction").alias("f"))
    return items, s


def count(spark, a):
    reports.state_counts(store.Store(spark, a.store).read("item"), ["run_id"]).show(1000, False)


def status(spark, a):
    reports.progress(store.Store(spark, a.store).read("item"), ["run_id"]).show(1000, False)


def cost(spark, a):
    s, p = store.Store(spark, a.store), config.pricing(config.read_text(spark, a.pricing))
    items = s.read("item").withColumn("accepted", F.col("decision.accepted"))
    calls = items.select("item_id", F.explode("calls").alias("c")).select("item_id", "c.*")
    reports.cost_per_configuration(items.select("item_id", "run_id", "configuration_id", "state", "accepted"), s.read("run"), calls, p.frame(spark), p.gpu_low, p.gpu_high).orderBy("configuration_id").show(1000, False)


def experiment_cost(spark, a):
    s, p = store.Store(spark, a.store), config.pricing(config.read_text(spark, a.pricing))
    q = s.read("quiz").where(F.col("run_id") == a.run) if a.run else s.read("quiz")
    calls = q.select("configuration_id", F.explode("calls").alias("c")).select("configuration_id", "c.*")
    reports.quiz_cost(q, calls, p.frame(spark), p.gpu_low, p.gpu_high).show(1000, False)
    reports.phase_usage(calls).show(1000, False)


def sweep(spark, a):
    reports.threshold_sweep(_log_frames(spark, a.log)[1]).orderBy("step").show(50, False)


def report(spark, a):
    items, s = _log_frames(spark, a.log)
    items = items.withColumn("bucket", reports.bucket_of(F.col("f")))
    reports.crosstab(items, s, "bucket", [b[0] for b in reports.BUCKETS]).orderBy("position").show(50, False)
    reports.crosstab(items.where("requested_difficulty is not null"), s, "requested_difficulty").orderBy("requested_difficulty").show(200, False)


def redecide(spark, a):
    s = store.Store(spark, a.store)
    items = s.read("item").join(s.read("run").select("run_id"), "run_id", "left_semi").where("decision is not null")
    sev = items.select("item_id", F.explode("decision.mode_verdicts").alias("mode", "v")).select("item_id", "mode", F.col("v.severity").alias("severity"))
    stored = items.select("item_id", F.col("decision.accepted").alias("accepted"), F.col("decision.aggregate_score").alias("aggregate_score"))
    r = quality.redecide(sev, stored, a.threshold, tuple(a.gate) if a.gate else None)
    if a.write:
        new = items.join(r.where("changed").select("item_id", F.col("accepted").alias("a"), F.col("aggregate_score").alias("g")), "item_id")
        s.append("item", new.withColumn("decision", F.col("decision").withField("accepted", F.col("a")).withField("aggregate_score", F.col("g"))))
    r.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("changed").cast("long")).alias("changed"), F.sum(F.col("accepted").cast("long")).alias("accepted")).show()


def failures(spark, a):
    items = store.Store(spark, a.store).read("item")
    calls = items.select("item_id", F.explode("calls").alias("c")).select("item_id", "c.*")
    reports.failures(items, calls).orderBy("run_id", "kind", "category").show(1000, False)
    reports.failure_totals(items, calls).show(1000, False)


def export_benchmark(spark, a):
    items = store.Store(spark, a.store).read("item").where("state = 'FILTERED'")
    put = items.select("configuration_id", "run_id", "topic_key", F.col("decision.accepted").alias("accepted"), F.col("provenance.requested_difficulty").alias("requested_difficulty"), F.transform("provenance.grounding_chunk_ids", lambda c: F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", 1)).otherwise("")).alias("lectures"))
    export.write_quiz_files(export.item_groups(put, a.export_granularity, a.export_condition), a.out)


def corpus_report(spark, a):
    corpus.document_report(course_files.pages(spark, a.corpus).where("error is null").drop("error")).orderBy("document_id").show(1000, False)


def retrieval_only(spark, a):
    index = spark.read.parquet(a.index)
    q = spark.read.parquet(a.queries)
    export.write_csv(export.retrieval_csv(retrieval.top_k(q, index, a.top_k, order="chunk_id")), a.out)


def plan(spark, a):
    p = config.sweep_plan(config.read_text(spark, a.file))
    for c in p.configurations:
        print(c.configuration_id)
    print(f"{len(p.configurations)} configurations, {p.repetitions} repetitions")


def doctor(spark, a):
    """Checks that need no network: each is OK, WARN or BLOCKED; ready without a BLOCKED one."""
    out, held = readiness.parsed(spark, {n: getattr(a, n) for n in ("requests", "manifest", "pricing", "models", "sweep")})
    if a.store:
        out.append(readiness.store(a.store))
    if a.corpus:
        out += readiness.corpus(spark, a.corpus)
    if a.index:
        out.append(readiness.index(spark, a.index))
    if {"sweep", "models", "requests"} <= set(held):
        out += readiness.plan(held["sweep"], held["models"], held.get("pricing", config.Pricing()), held["requests"])
    if {"manifest", "requests"} <= set(held) and a.corpus and readiness.ready(out):
        out += readiness.courses(held["requests"], {held["manifest"].course_key: held["manifest"]}, course_files.files(spark, a.corpus))
    spark.createDataFrame([(c.name, c.status, c.detail) for c in out], "check string, status string, detail string").show(100, False)
    return 0 if readiness.ready(out) else 1


def _roles(a, spark) -> dict:
    """The roles that ``module:function`` makes of the model catalogue."""
    module, _, name = a.clients.partition(":")
    return getattr(importlib.import_module(module), name)(config.models(config.read_text(spark, a.models)))


def _experiment(spark, a, roles=None) -> experiment.Experiment:
    plan = config.sweep_plan(config.read_text(spark, a.plan))
    if a.run_as:
        plan = replace(plan, sweep=a.run_as)
    asked = config.requests(config.read_text(spark, a.requests))
    table = lambda name: spark.read.parquet(getattr(a, name))
    tables = [table(x) for x in ("grounding", "material", "documents", "retrieved")]
    return experiment.Experiment(spark, store.Store(spark, a.store), plan, asked, roles if roles is not None else _roles(a, spark), *tables)


def run_experiment(spark, a):
    """Start an experiment, or take it up where it stands; the same command does both."""
    made = _experiment(spark, a).run()
    print(f"{made['items']} pool items and {made['quizzes']} quizzes made, {_experiment(spark, a).work().count()} quizzes left")


def run_plan(spark, a):
    """Work off a run plan; ``--topic`` takes one of its topics alone."""
    plan = config.run_plan(config.read_text(spark, a.plan))
    if a.run_as:
        plan = replace(plan, plan=a.run_as)
    topics = spark.read.parquet(a.topics)
    if chosen := [a.topic] if a.topic else list(plan.topics):
        topics = topics.where(F.col("topic").isin(chosen))
    topics = ranked(topics, [], ["position"]).select((F.col("__n") - 1).alias("position"), "topic", "grounding")
    print(f"{experiment.run_plan(store.Store(spark, a.store), plan, topics, _roles(a, spark))} new items")


def export_experiment(spark, a):
    """Write a stored experiment as evaluator input, replacing the export there as a whole."""
    quizzes = store.Store(spark, a.store).read("quiz")
    asked = config.requests(config.read_text(spark, a.requests))
    comps = spark.read.parquet(a.competencies)
    exports.write_files(experiment.evaluator_files(spark, quizzes.where(F.col("run_id") == a.run), asked, comps), a.out)
    print(exports.current(a.out))


TASKS = {
    "count": (count, ["store"]), "experiment-status": (status, ["store"]), "cost": (cost, ["store", "pricing"]), "experiment-cost": (experiment_cost, ["store", "pricing", "?run"]), "sweep": (sweep, ["log"]), "report": (report, ["log"]),
    "redecide": (redecide, ["store"]), "failures": (failures, ["store"]), "export-benchmark": (export_benchmark, ["store", "out"]), "corpus-report": (corpus_report, ["corpus"]), "retrieval-only": (retrieval_only, ["index", "queries", "out"]),
    **{name: (run_experiment, ["store", "plan", "requests", "models", "clients", "grounding", "material", "documents", "retrieved"]) for name in ("experiment", "resume")},
    "run-plan": (run_plan, ["store", "plan", "topics", "models", "clients"]), "export-experiment": (export_experiment, ["store", "run", "requests", "competencies", "out"]),
    "plan": (plan, ["file"]), "doctor": (doctor, ["?requests", "?manifest", "?pricing", "?models", "?sweep", "?store", "?corpus", "?index"]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    tasks = p.add_subparsers(dest="task", required=True)
    for name, (_, needs) in TASKS.items():
        t = tasks.add_parser(name)
        for n in needs:
            t.add_argument(f"--{n.lstrip('?')}", required=not n.startswith("?"))
        if name == "redecide":
            t.add_argument("--threshold", type=float, default=0.7)
            t.add_argument("--gate", nargs="*")
            t.add_argument("--write", action="store_true")
        if name == "export-benchmark":
            t.add_argument("--export-granularity", choices=export.GRANULARITIES, default="configuration_topic")
            t.add_argument("--export-condition", choices=export.CONDITIONS, default="all")
        if name in ("experiment", "resume", "run-plan"):
            t.add_argument("--as", dest="run_as", help="another name to store it under")
        if name == "run-plan":
            t.add_argument("--topic")
        if name == "retrieval-only":
            t.add_argument("--top-k", type=int, default=12)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return TASKS[a.task][0](_session(), a) or 0


if __name__ == "__main__":
    raise SystemExit(main())
