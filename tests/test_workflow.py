"""Model operators and workflows with a scripted client; configuration files; file sources; streaming."""

import json
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.plans import model as m
from lectern.plans import workflow as w
from lectern.schemas import CALL, FAILURE_MODES, SCOPES
from lectern.sources import config, files
from lectern.streaming import progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Scripted:
    """Answers by a rule of the prompts; deterministic, so it can be sent to executors."""

    def __init__(self, severity=0.0, fail=None, style="good"):
        self.severity, self.fail, self.style = severity, fail, style

    def call(self, model, temperature, system, user):
        if self.fail:
            raise m.CallError("no", self.fail)
        if system == w.FILTER_SYSTEM:
            modes = user.split("modes ")[1].split(".\n")[0].split(", ")
            bad = 0.9 if "BAD" in user else self.severity
            return m.Reply(json.dumps({"modes": [{"mode": x.lower(), "severity": bad, "triggered": bad > 0.5, "justification": "j"} for x in modes], "rationale": "r"}), 10, 5)
        if system == w.SELECT_SYSTEM:
            ids = [int(x.split("]")[0]) for x in user.split("[")[1:] if x.split("]")[0].isdigit()]
            return m.Reply(json.dumps({"chosen": [999, *ids[:3], ids[0]], "rejected": [], "rationale": ""}), 7, 3)
        n = int(user.split("Write ")[1].split(" ")[0])
        if self.style == "bad json":
            return m.Reply("not json", 1, 1)
        q = lambda i: {"type": "single_choice", "title": f"T{i}", "questionText": f"{'BAD ' if i == 0 else ''}question {i} of {n}?", "options": [{"text": f"{x}{i}", "correct": x == "alpha"} for x in ("alpha", "beta", "gamma", "delta")], "explanation": "e"}
        return m.Reply(json.dumps({"questions": [q(i) for i in range(n)]})[:-1] + ",}", 100, 50)


@pytest.fixture()
def keep(tmp_path):
    def f(df):
        path = f"file://{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return f


def test_calls_retry_what_may_pass():
    waits, replies = [], [m.CallError("x", 429), m.CallError("y", 503), m.Reply("ok", 1, 2)]

    class C:
        def call(self, *a):
            r = replies.pop(0)
            if isinstance(r, Exception):
                raise r
            return r

    text, rec = m.execute(C(), "s", "m", float("nan"), 5, "", "", waits.append)
    assert (text, rec["retry_count"], rec["outcome"], rec["failure_category"], waits) == ("ok", 2, "success", None, [1.0, 2.0])
    for status, kind, tries in ((401, "AUTH", 0), (404, "BAD_REQUEST", 0), (408, "TIMEOUT", 1), (500, "TRANSPORT", 1)):
        text, rec = m.execute(Scripted(fail=status), "s", "m", None, 2, "", "", lambda s: None)
        assert (text, rec["failure_category"], rec["retry_count"], rec["outcome"]) == (None, kind, tries, "error")
    with pytest.raises(ValueError):
        m.execute(Scripted(), "s", "m", None, 0, "", "")
    assert m.render("a {{x}} {{y}}", {"x": 1}) == "a 1 {{y}}"
    assert m.execute(Scripted(fail=401), "s", "m", None, 1, "", "")[1].keys() == {f.name for f in CALL.fields}


def requests_df(spark, n=3):
    return spark.createDataFrame([("r1", "topic", ["single-choice"], "easy", None, n, "G")], "request_key string, topic string, types array<string>, difficulty string, instructions string, n int, grounding string")


def test_agentic_rounds(spark, keep):
    q, calls = w.agentic(requests_df(spark), w.Role("g", Scripted()), w.Role("j", Scripted()), keep)
    got = [(r.round, r.status, r.item.question_text) for r in q.orderBy("round", "pos").collect()]
    # the first question of a batch is bad; each round asks for what is missing; "1 of 1" is rejected and ends the request
    assert got == [(1, "rejected", "BAD question 0 of 3?"), (1, "accepted", "question 1 of 3?"), (1, "accepted", "question 2 of 3?"), (2, "rejected", "BAD question 0 of 1?")]
    assert calls.count() == 2 + 4
    q, calls = w.agentic(requests_df(spark), w.Role("g", Scripted(style="bad json"), max_attempts=1), w.Role("j", Scripted()), keep, max_rounds=3)
    assert q.count() == 0 and [r.call.failure_category for r in calls.collect()] == ["GENERATION_MALFORMED_JSON"] * 3


def test_judging_labels_what_is_wrong(spark):
    def judged(text):
        df = spark.createDataFrame([(1, text)], "i int, response string").withColumn("call", F.lit(None).cast(CALL)).withColumn("call", F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in CALL.fields]))
        return m.decisions(df, ["i"], "GENERAL", 0.7, None, "j").first()

    whole = {"modes": [{"mode": x, "severity": 0.2} for x in SCOPES["GENERAL"]]}
    assert judged(" ").call.failure_category == "FILTER_EMPTY_RESPONSE"
    assert judged("{").call.failure_category == "FILTER_MALFORMED_JSON"
    assert judged('{"modes": []}').call.failure_category == "FILTER_NO_MODES"
    assert judged(json.dumps({"modes": whole["modes"][:4]})).call.failure_category == "FILTER_INCOMPLETE_VERDICT"
    ok = judged(json.dumps(whole))
    assert ok.decision.accepted and ok.decision.aggregate_score == 0.8 and len(ok.decision.mode_verdicts) == 5 and ok.call.failure_category is None


def test_two_phase_shortlists_and_cleans(spark, keep):
    item = F.struct(F.lit("single-choice").alias("type"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("q").alias("question_text"), F.expr("array(struct('a' as text, true as correct))").alias("options"))
    c = spark.range(1, 8).withColumn("request_key", F.lit("r")).withColumn("item", item).select("request_key", "id", "item")
    req = spark.createDataFrame([("r", 2)], "request_key string, n int")
    chosen, calls = w.two_phase(req, c, w.Role("s", Scripted()), keep, max_candidates=4)
    assert [(r.rank, r.id) for r in chosen.orderBy("rank").collect()] == [(1, 1), (2, 2)] and calls.count() == 3
    chosen, calls = w.two_phase(req, c, w.Role("s", Scripted()), keep)
    assert [r.id for r in chosen.orderBy("rank").collect()] == [1, 2] and calls.count() == 1


def test_pool_build_pairs_by_position(spark, keep):
    items = spark.range(5).select(F.col("id").alias("item_id"), F.lit("c").alias("cell_key"), F.lit("single-choice").alias("question_type"), F.lit("easy").alias("difficulty_band"), F.lit("G").alias("grounding"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("calls"))
    r = {x.item_id: x for x in w.build_pool(items, w.Role("g", Scripted()), w.Role("j", Scripted()), keep, batch_size=3).collect()}
    assert [r[i].state for r_ in [r] for i in range(5)] == ["FILTERED"] * 5
    assert [len(r[i].calls) for i in range(5)] == [2, 1, 1, 2, 1]  # a batch's call is on its first item
    assert [r[i].decision.accepted for i in range(5)] == [False, True, True, False, True]
    r = w.build_pool(items, w.Role("g", Scripted(fail=401)), w.Role("j", Scripted()), keep).collect()
    assert {(x.state, x.failure) for x in r} == {("FAILED_GENERATION", "AUTH")}


def test_top_up_stops_without_gain(spark):
    req = spark.createDataFrame([("r", 5, 2)], "request_key string, n int, cells int")
    accepted, grown = [1, 3, 3, 9], []
    make = lambda: spark.createDataFrame([("r", accepted.pop(0))], "request_key string, accepted int")
    w.top_up(req, make, lambda d: grown.append(d.first().per_cell), 5)
    assert grown == [2, 1] and accepted == [9]


def test_finished_sweeps_have_no_work(spark):
    conf, req = spark.createDataFrame([("c",)], "configuration_id string"), spark.createDataFrame([("r",)], "request_key string")
    call = F.array(F.struct(F.lit("TIMEOUT").alias("failure_category")))
    quiz = spark.range(1).select(F.lit("c").alias("configuration_id"), F.lit("r").alias("request_key"), F.lit(1).alias("repetition"), F.array(F.lit(1)).alias("questions"), call.alias("calls"))
    assert w.sweep_progress(conf, req, 1, quiz).count() == 0
    assert w.sweep_progress(conf, req, 2, quiz.withColumn("questions", F.array().cast("array<int>"))).count() == 2


REQUEST = "- {key: a, course: EIDI, competencies: [x], language: de, question-types: [single-choice], number-of-questions: 3, difficulty: easy}\n"


def test_requests():
    r = config.requests(REQUEST)[0]
    assert r.competency_mode and r.number_of_questions == 3
    for text, why in (
        (REQUEST + REQUEST, "named twice"), (REQUEST.replace("course", "curse"), "unknown field"), (REQUEST.replace("competencies: [x]", "competencies: [x], topic: t"), "exactly one"), (REQUEST.replace(": 3", ": 21"), "more than"),
        (REQUEST.replace("[single-choice]", "[]"), "question type"), (REQUEST.replace("easy", "odd"), "none of"), ("x: 1", "list"), (REQUEST.replace("competencies", f"prompt: {'y' * 2001}, competencies"), "longer"),
    ):
        with pytest.raises(config.ConfigError, match=why):
            config.requests(text)


MANIFEST = """
course: {key: or, title: OR}
competencies:
  - {key: a, title: Alpha, description: "- x\\n- y", lectureUnits: [{document: d.pdf}], exercises: [{document: e.pdf, weight: 0.5}, {document: d.pdf}]}
  - {key: b, title: Beta (hard), query: q, taxonomy: APPLY, relations: [{type: ASSUMES, target: a}]}
"""


def test_manifests(spark):
    man = config.manifest(MANIFEST)
    a, b = man.competencies
    assert a.retrieval_query == "Alpha. x y" and b.retrieval_query == "q" and a.documents == ["d.pdf", "e.pdf", "d.pdf"] and a.taxonomy == "UNDERSTAND"
    f = man.frames(spark)
    assert f["link"].count() == 3 and f["relation"].first().target == "a"
    for old, new, why in (("target: a", "target: z", "undeclared"), ("key: b", "key: a", "named twice"), ("APPLY", "KNOW", "none of")):
        with pytest.raises(config.ConfigError, match=why):
            config.manifest(MANIFEST.replace(old, new))
    req = config.requests(REQUEST.replace("[x]", "[a, b]"))[0]
    assert config.match_competency(" ALPHA (1) ", req, man) == "a" and config.match_competency("b", req, man) == "b" and config.match_competency("c", req, man) is None
    assert [r.competency_keys for r in config.request_builder(man, "de", ("single-choice",), 3, "easy")] == [("a",), ("b",)]
    cat = config.catalogue('[{"title": "Über Maß", "description": ["p", "q"]}]')
    assert cat.competencies[0].key == "über-maß" and cat.competencies[0].description == "p\nq"
    with pytest.raises(config.ConfigError, match="empty key"):
        config.catalogue('[{"title": "!!"}]')


def test_plans_prices_models(spark):
    plan = config.sweep_plan("sweep: s\nrequests-file: f\nconfigurations: [{id: a, approach: agentic, generator: g, judge: j}]")
    assert (plan.repetitions, plan.items_per_cell, plan.generation_batch_size, plan.max_rounds, plan.configurations[0].configuration_id) == (3, 20, 12, 5, "agentic|g|j|j")
    with pytest.raises(config.ConfigError):
        config.sweep_plan("sweep: s\nrequests-file: f\nrepetitions: 0\nconfigurations: [{id: a, approach: agentic, generator: g, judge: j}]")
    name, text = config.write_run_plan("My Plan!", ["g 1", "g2"], ["f"], 4, set())
    assert name == "my-plan.yml" and [c[0] for c in config.run_plan(text).configurations] == ["g-1-gen-f-filter", "g2-gen-f-filter"]
    with pytest.raises(config.ConfigError, match="exists"):
        config.write_run_plan("my plan", ["g"], ["f"], 4, {"my-plan.yml"})
    p = config.pricing("models: {a: {billing: gpu-time}, b: {billing: tokens, input-eur-per-million: 1, output-eur-per-million: 2}}\ngpu: {rental-eur-per-hour: 1.2}")
    assert (p.gpu_low, p.gpu_high) == (0.0, 1.2) and p.frame(spark).count() == 2
    with pytest.raises(config.ConfigError):
        config.pricing("models: {b: {billing: tokens, input-eur-per-million: 1}}")
    with pytest.raises(config.ConfigError, match="declared"):
        config.models("backends: {}\nmodels: {m: {backend: x}}")
    assert config.topic_lines("a\n\n # c\n b ") == ["a", "b"]
    assert config.safe_name("run-1.a") and not config.safe_name(".x") and config.safe_path("a/./b") == "a/b"
    for bad in ("../x", "/x", "c:x", ""):
        with pytest.raises(config.ConfigError):
            config.safe_path(bad)


def test_files(spark, tmp_path):
    (tmp_path / "01 A").mkdir()
    (tmp_path / "01 A" / "x.PDF").write_text(" one \ftwo")
    (tmp_path / "y.pdf").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "z.txt").write_text("no")
    r = files.scan(spark, f"file://{tmp_path}", files.plain_pages).orderBy("document_id", "page_number").collect()
    assert [(x.document_id, x.lecture, x.unit, x.page_number, x.text) for x in r] == [("01 A/x.PDF", "01 A", "x", 1, "one"), ("01 A/x.PDF", "01 A", "x", 2, "two"), ("y.pdf", "(root)", "y", None, None)]
    assert r[2].error.startswith("UnicodeDecodeError") and files.content_hashes(spark, f"file://{tmp_path}").count() == 3
    (tmp_path / "topics.txt").write_text("a\n# b\n\n c \n")
    assert [x.topic for x in files.topics(spark, f"file://{tmp_path}/topics.txt").collect()] == ["a", "c"]
    record = {"schema_version": 2, "run_id": "r", "filter_decision": {"accepted": True, "mode_verdicts": {m_: {"severity": 0.5} for m_ in FAILURE_MODES[:2]}}}
    (tmp_path / "log.jsonl").write_text(json.dumps(record) + "\n" + json.dumps({"run_id": "q"}) + "\n")
    log = files.run_log(spark, f"file://{tmp_path}/log.jsonl")
    assert log.count() == 2 and files.severities_of(log).count() == 2
    chunks = spark.createDataFrame([("a#p1-1", [1.0])], "chunk_id string, embedding array<float>")
    index = f"file://{tmp_path}/index"
    assert files.read_index(spark, index, "f", chunks) is None
    files.write_index(chunks, "f", index)
    assert files.read_index(spark, index, "f", chunks).count() == 1 and files.read_index(spark, index, "g", chunks) is None
    assert files.read_index(spark, index, "f", chunks.withColumn("chunk_id", F.lit("b"))) is None


def test_lenient_json(spark):
    df = spark.createDataFrame([("{'a': 'x\\q', \"b\": [1, 2,],}",)], "j string")
    assert df.select(files.lenient_json("j", "a string, b array<int>").alias("r")).first().r.b == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    events = [(1, "r", "PENDING", 1), (1, "r", "GENERATED", 3), (2, "r", "PENDING", 1), (1, "r", "GENERATING", 2), (3, "q", "FILTERED", 9)]
    df = spark.createDataFrame(events, "item_id long, run_id string, state string, seq long").withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    for i, part in enumerate(df.randomSplit([0.5, 0.5], 1)):
        part.write.mode("append").parquet(f"{tmp_path}/events")
    q = progress.current_states(progress.read_events(spark, f"{tmp_path}/events", 1)).writeStream.outputMode("complete").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    live = {(r.run_id, r.item_id): r.state for r in spark.table("states").collect()}
    assert live == {("r", 1): "GENERATED", ("r", 2): "PENDING", ("q", 3): "FILTERED"}
    p = {r.run_id: r for r in progress.progress_now(df).collect()}
    assert (p["r"].total, p["r"].awaiting_judge, p["r"].to_generate, p["q"].percent) == (2, 1, 1, 100)
    w_ = progress.event_rates(progress.read_events(spark, f"{tmp_path}/events")).writeStream.outputMode("update").format("memory").queryName("rates").start()
    w_.processAllAvailable()
    w_.stop()
    assert sum(r.events for r in spark.table("rates").collect()) == 5


def test_cli(spark, tmp_path, capsys, monkeypatch):
    from lectern.operators.store import Store
    from lectern.plans import cli

    monkeypatch.setattr(cli, "_session", lambda: spark)
    s = Store(spark, f"file://{tmp_path}/s")
    s.enqueue(spark.createDataFrame([(1, "r", "c", "t", 0)], "item_id long, run_id string, configuration_id string, topic_key string, item_index int"))
    assert cli.main(["count", "--store", s.root]) == 0 and "PENDING" in capsys.readouterr().out
    (tmp_path / "p.yml").write_text("models: {m: {billing: gpu-time}}")
    assert cli.main(["cost", "--store", s.root, "--pricing", f"file://{tmp_path}/p.yml"]) == 0
    assert cli.main(["doctor", "--pricing", f"file://{tmp_path}/p.yml"]) == 0 and cli.main(["doctor", "--pricing", f"file://{tmp_path}/none.yml"]) == 1
    for task in ("experiment-status", "failures"):
        assert cli.main([task, "--store", s.root]) == 0


class Lengths:
    def embed(self, texts):
        return [[float(len(x)), 1.0] for x in texts]


def test_embedding(spark):
    df = spark.createDataFrame([("a", "xy"), ("b", None)], "chunk_id string, text string")
    assert [r.embedding for r in m.embed(df, Lengths(), at_once=1).orderBy("chunk_id").collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_mappings():
    cat = config.catalogue('[{"title": "Alpha"}, {"title": "Beta"}]', "c")
    decks = {"a.pdf": "01 A", "b.pdf": "01 A", "c.pdf": "02 C"}
    found = config.mapping_problems("c", cat, decks, {"alpha": ["a.pdf", "x.pdf"], "gamma": []}, {"a.pdf", "b.pdf", "d.pdf"})
    assert [p.split(": ", 1)[1] for p in found] == ["'alpha' links 'x.pdf', which is no deck", "'gamma' matches no competency", "file 'd.pdf' has no deck", "deck 'c.pdf' has no file", "folder '01 A' holds 2 decks"]
    man = config.manifest_of("c", cat, decks, {"alpha": ["a.pdf"]})
    assert man.by_key("alpha").documents == ["01 A/a.pdf"] and man.by_key("beta").documents == []
    r = config.requests(REQUEST.replace("[x]", "[a, b]"))
    assert [(x.key, x.competency_keys) for x in config.split_requests(r)] == [("a-a", ("a",)), ("a-b", ("b",))]


def test_prompts_of_each_kind(spark):
    from lectern.plans import prompts

    rows = [("a", "Trees", False), ("b", "k1, k2", True)]
    df = spark.createDataFrame(rows, "request_key string, topic string, by_competency boolean").selectExpr(
        "*", "2 as missing", "array('single-choice') as types", "'easy' as difficulty", "cast(null as string) as instructions", "'G' as grounding"
    )
    a, b = (r.u for r in df.select("request_key", w._asking(df).alias("u")).orderBy("request_key").collect())
    assert a.startswith("Write 2 question(s) of the types single-choice at difficulty easy.\nTopic: Trees\n") and a.endswith("Instructions: (none)\nG") and "competency" not in a
    assert "k1, k2" in b and '"competency"' in b and "{{" not in a + b
    assert all(f"- {x}: " in prompts.judging(s) for s, modes in SCOPES.items() for x in modes)
    assert "{{request}}" in prompts.judging("COMBINED") and "{{request}}" not in prompts.judging("GENERAL") and set(prompts.MODES) == set(FAILURE_MODES)
