"""What the store keeps of rows that meet on a key, in one write or several."""

from pyspark.sql import functions as F

from lectern.operators.store import Store
from lectern.sources import files


def quizzes(spark, rows):
    return spark.createDataFrame(rows, "quiz_id string, run_id string, request_key string, repetition int").withColumn("configuration_id", F.lit("c"))


def read(s):
    return sorted((r.quiz_id, r.run_id, r.request_key, r.repetition) for r in s.read("quiz").collect())


def test_one_write_with_the_same_quiz_or_place_twice(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append("quiz", quizzes(spark, [("q1", "a", "r", 1), ("q1", "b", "r", 1), ("q2", "x", "r", 1), ("q3", "x", "r", 1), ("q4", None, "r", 1), ("q5", None, None, 1)]).coalesce(1))
    assert read(s) == [("q1", "b", "r", 1), ("q3", "x", "r", 1), ("q4", None, "r", 1), ("q5", None, None, 1)]
    s.append("quiz", quizzes(spark, [("q9", "b", "r", 1), ("q3", "y", "r", 2)]).coalesce(1))
    assert read(s) == [("q3", "y", "r", 2), ("q4", None, "r", 1), ("q5", None, None, 1), ("q9", "b", "r", 1)]
    assert read(s) == read(s)


def test_one_write_with_the_same_item_twice(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "r", "c", "t", 0, "PENDING"), (1, "r", "c", "t", 0, "GENERATED")], "item_id long, run_id string, configuration_id string, topic_key string, item_index int, state string")
    s.append("item", rows.coalesce(1))
    assert [r.state for r in s.read("item").collect()] == ["GENERATED"]


def test_records_of_a_log_keep_their_numbers(spark, tmp_path):
    record = '{"run_id": "r", "filter_decision": {"accepted": true, "mode_verdicts": {"OFF_TOPIC": {"severity": 0.5}, "FACTUAL_ERROR": {"severity": 0.1}}}}'
    (tmp_path / "log.jsonl").write_text("\n".join([record] * 3))
    s = files.severities_of(files.run_log(spark, f"file://{tmp_path}/log.jsonl"))
    assert s.count() == 6 and s.select("item_id").distinct().count() == 3
    assert s.alias("a").join(s.alias("b"), ["item_id", "mode"]).count() == 6


def test_printed_forms(spark):
    import yaml

    from lectern.functions import text as t
    from lectern.operators import export

    none = float("nan")
    rows = [(0.125, 1.0, 2.0, {"SOLUTION": 1, "LECTURE_DECK": 3}, 0.25, 0), (None, 1.5, 1.5, {}, 0.0, 2), (1.0, none, 1.0, None, 0.0, 0)]
    df = spark.createDataFrame(rows, "share double, low double, high double, counts map<string, int>, fraction double, unknown int").coalesce(1)
    found = df.select(t.percent("share").alias("p"), t.band("low", "high").alias("b"), t.composition_text("counts", "fraction", "unknown").alias("c")).collect()
    assert [tuple(r) for r in found] == [("13%", "1.0000-2.0000", "3 lecture deck, 1 solution (25% solution)"), ("-", "1.5000", "2 unknown (0% solution)"), ("100%", "n/a", " (0% solution)")]
    metrics = {m["name"]: m["enabled"] for m in yaml.safe_load(export.evaluator_config("x"))["metrics"]}
    assert len(metrics) == 14 and not metrics["coverage"] and metrics["clarity"]
