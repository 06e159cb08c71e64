"""Whole experiments with a scripted client: pools, quizzes, resuming, refusals and exports."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.operators.store import Store
from lectern.plans import cli, experiment, model, workflow
from lectern.sources import config, exports

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Scripted:
    """Answers by a rule of the prompts and writes down each call; a name in ``down`` doesn't answer while that file is there."""

    def __init__(self, folder, name, down=None):
        self.folder, self.name, self.down = str(folder), name, down

    def call(self, asked, temperature, system, user):
        with open(f"{self.folder}/calls-{os.getpid()}.txt", "a") as f:
            f.write(f"{self.name}\n")
        if self.down and os.path.exists(f"{self.folder}/{self.down}"):
            raise model.CallError("down", 503)
        if system == workflow.FILTER_SYSTEM:
            modes = user.split("modes ")[1].split(".\n")[0].split(", ")
            bad = 0.9 if "BAD" in user else 0.1
            return model.Reply(json.dumps({"modes": [{"mode": x, "severity": bad, "triggered": bad > 0.5} for x in modes]}), 10, 5)
        if system == workflow.SELECT_SYSTEM:
            ids = [int(line[1:].split("]")[0]) for line in user.split("\n") if line.startswith("[") and line[1:].split("]")[0].lstrip("-").isdigit()]
            n = int(user.split("Select ")[1].split(" ")[0])
            return model.Reply(json.dumps({"chosen": ids[:n]}), 7, 3)
        n = int(user.split("Write ")[1].split(" ")[0])
        q = lambda i: {"type": "single-choice", "title": f"T{i}", "questionText": f"{'BAD ' if i == 0 and n > 1 else ''}question {i} of {n}?", "options": [{"text": f"{x}{i}", "correct": x == "alpha"} for x in ("alpha", "beta", "gamma", "delta")]}
        return model.Reply(json.dumps({"questions": [q(i) for i in range(n)]}), 100, 50)


PLAN = """
sweep: trial
requests-file: r.yml
repetitions: 1
pool: {items-per-cell: 3, generation-batch-size: 3, languages: [en], question-types: [single-choice], difficulties: [easy]}
selection: {top-up-rounds: 2, max-attempts: 1}
agentic: {max-rounds: 2}
configurations:
  - {id: ag, approach: agentic, generator: g, judge: j}
  - {id: tp, approach: two-phase, generator: g, judge: j}
  - {id: tp2, approach: two-phase, generator: g, judge: j2, selector: s}
"""
REQUESTS = """
- {key: a, course: PSE, competencies: [k1], language: en, question-types: [single-choice], number-of-questions: 2, difficulty: easy}
- {key: b, course: PSE, competencies: [k1, k2], language: en, question-types: [single-choice], number-of-questions: 5, difficulty: easy}
"""


@pytest.fixture(autouse=True)
def small(spark):
    """Many small steps: two partitions each are enough."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture
def made(spark, tmp_path):
    def build(requests=REQUESTS, documents=(("PSE", "d1", "h1"),), plan=PLAN, **roles):
        every = {k: workflow.Role(f"model-{k}", Scripted(tmp_path, k, roles.get(k)), max_attempts=1) for k in ("g", "j", "j2", "s")}
        frame = lambda rows, names: spark.createDataFrame(rows, names)
        asked = config.requests(requests)
        return experiment.Experiment(
            spark, Store(spark, f"file://{tmp_path}/store"), config.sweep_plan(plan), asked, every, frame([(r.key, "G") for r in asked], "request_key string, grounding string"),
            frame([("PSE", k, f"M{k}") for k in ("k1", "k2")], "course_key string, competency_key string, grounding string"),
            frame(list(documents), "course_key string, document string, content_hash string"), frame([("k1", "d1#p1-2"), ("k2", "d2#p1-2")], "competency_key string, chunk_id string"),
        )

    return build


def calls(folder):
    names = [n for f in os.listdir(folder) if f.startswith("calls-") for n in open(f"{folder}/{f}").read().split()]
    return {n: names.count(n) for n in set(names)}


def test_an_experiment_from_start_to_export(spark, made, tmp_path):
    e = made()
    assert e.run()["quizzes"] == 3 * 2
    items, quizzes = e.store.read("item"), e.store.read("quiz")
    assert {r.state for r in items.select("state").distinct().collect()} == {"FILTERED"}
    # a batch of several has one bad question: b needs five good ones of two cells and gets them by growing these
    per = {r.topic_key: r["count"] for r in items.groupBy("topic_key").count().collect()}
    assert set(per) == {"PSE|k1|en|single-choice|easy", "PSE|k2|en|single-choice|easy"} and min(per.values()) > 3
    by = {(r.configuration_id, r.request_key, r.repetition): r for r in quizzes.collect()}
    assert len(by) == 6 and by["agentic|g|j|j", "a", 1].quiz_id == "trial-ag-a-r1"
    two = by["two-phase|g|j|j", "b", 1]
    assert two.complete and len(two.questions) == 5 and two.candidate_count >= 5
    assert all(q["item"].question_text.startswith("question") and q.competency_key in ("k1", "k2") for q in two.questions)
    assert not by["agentic|g|j|j", "a", 1].complete or len(by["agentic|g|j|j", "a", 1].questions) == 2
    # the second judge has told about every item
    judged = e.store.read("verdict").groupBy("judge_model").count().collect()
    assert {r.judge_model for r in judged} == {"model-j", "model-j2"}

    before = calls(tmp_path)
    grown = made(documents=[("PSE", "d1", "h1")])
    assert made().run() == {"items": 0, "quizzes": 0} and grown.work().count() == 0
    after = calls(tmp_path)
    assert {k: after[k] - before.get(k, 0) for k in after if after[k] != before.get(k, 0) and k != "j2"} == {}  # a finished experiment asks nobody
    with pytest.raises(ValueError, match="another manifest"):
        made(documents=[("PSE", "d1", "h2")]).run()

    comps = spark.createDataFrame([("PSE", "k1", "Trees", "About trees", "APPLY")], "course_key string, competency_key string, title string, description string, taxonomy string")
    exports.write_files(e.export_files(comps), f"{tmp_path}/out")
    found = {r.file: json.loads(bytes(r.content)) for r in exports.read(spark, f"{tmp_path}/out").collect()}
    assert {f.split("/")[0] for f in found} == {"quizzes", "sidecars", "instructions"}
    public, hidden = found["quizzes/trial-tp-a-r1.json"]["questions"], found["sidecars/trial-tp-a-r1.json"]["questions"]
    assert [q["question_id"] for q in public] == [q["question_id"] for q in hidden] and public[0]["competency"] == "Trees"
    assert "generator_id" not in public[0] and hidden[0]["generator_id"] == "two-phase|g|j|j"


def test_quizzes_behind_a_dead_call_are_made_again(spark, made, tmp_path):
    (tmp_path / "outage").write_text("")
    of = {"requests": REQUESTS.split("- {key: b")[0], "plan": PLAN.split("  - {id: ag")[0] + PLAN[PLAN.index("  - {id: tp2") :], "s": "outage"}
    e = made(**of)
    assert e.run() == {"items": 3, "quizzes": 0}  # the selector doesn't answer: the pool stays, the quiz isn't stored
    assert [(r.configuration_id, r.request_key) for r in e.work().collect()] == [("two-phase|g|j2|s", "a")]
    os.remove(tmp_path / "outage")
    assert made(**of).run() == {"items": 0, "quizzes": 1} and e.work().count() == 0


def test_what_an_experiment_refuses(made):
    topic = REQUESTS + "- {key: t, course: PSE, topic: Trees, language: en, question-types: [single-choice], number-of-questions: 2, difficulty: easy}\n"
    with pytest.raises(config.ConfigError, match="competencies only"):
        made(topic)
    e = made()
    del e.roles["s"]
    with pytest.raises(config.ConfigError, match="no model for s"):
        e.__post_init__()


def test_a_run_plan_is_worked_off_once(spark, tmp_path):
    plan = config.run_plan("{plan: p, items-per-topic: 3, configurations: [{id: c1, generator: g, filter: j}, {id: c2, generator: g, filter: j}]}")
    topics = spark.createDataFrame([(0, "Trees", "G0"), (1, "Graphs", "G1")], "position long, topic string, grounding string")
    roles = {k: workflow.Role(k, Scripted(tmp_path, k), max_attempts=1) for k in ("g", "j")}
    s = Store(spark, f"file://{tmp_path}/store")
    assert experiment.run_plan(s, plan, topics, roles) == 12
    rows = s.read("item").orderBy("configuration_id", "topic_key", "item_index").collect()
    assert [(r.topic_key, r.item_index, r.difficulty) for r in rows[:3]] == [("Graphs", 0, 20), ("Graphs", 1, 50), ("Graphs", 2, 80)]
    assert {r.state for r in rows} == {"FILTERED"} and all(len(r.calls) == 2 for r in rows)
    before = calls(tmp_path)
    assert experiment.run_plan(s, plan, topics, roles) == 0 and calls(tmp_path) == before == {"g": 12, "j": 12}


def client_roles(models):
    """What the command line's ``--clients`` names."""
    return {k: workflow.Role(m["model"], Scripted(os.environ["SCRIPTED_FOLDER"], k), max_attempts=1) for k, m in models.items()}


def test_the_command_line_runs_resumes_and_exports(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("SCRIPTED_FOLDER", str(tmp_path))
    monkeypatch.setattr(cli, "_session", lambda: spark)
    small = PLAN.split("  - {id: tp2")[0]
    texts = {"plan.yml": small, "requests.yml": REQUESTS.split("- {key: b")[0], "models.yml": "{backends: {x: {}}, models: {g: {backend: x}, j: {backend: x, model: judge}}}"}
    texts["run.yml"] = "{plan: p, items-per-topic: 2, configurations: [{id: c1, generator: g, filter: j}]}"
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    frames = {
        "grounding": ([("a", "G")], "request_key string, grounding string"), "material": ([("PSE", "k1", "M")], "course_key string, competency_key string, grounding string"),
        "documents": ([("PSE", "d1", "h1")], "course_key string, document string, content_hash string"), "retrieved": ([("k1", "d1#p1-2")], "competency_key string, chunk_id string"),
        "topics": ([(3, "Trees", "G0"), (8, "Graphs", "G1")], "position long, topic string, grounding string"),
        "competencies": ([("PSE", "k1", "Trees", "About trees", "APPLY")], "course_key string, competency_key string, title string, description string, taxonomy string"),
    }
    for name, (rows, kinds) in frames.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}")
    at = lambda *names: [x for n in names for x in (f"--{n}", f"{tmp_path}/{n if n in frames or n == 'store' else n + '.yml'}")]
    base = [*at("store", "plan", "requests", "models", "grounding", "material", "documents", "retrieved"), "--clients", f"{__name__}:client_roles", "--as", "again"]
    assert cli.main(["experiment", *base]) == 0 and "2 quizzes made, 0 quizzes left" in capsys.readouterr().out
    assert cli.main(["resume", *base]) == 0 and "0 pool items and 0 quizzes made" in capsys.readouterr().out
    out = f"{tmp_path}/out"
    assert cli.main(["export-experiment", *at("store", "requests", "competencies"), "--run", "again", "--out", out]) == 0
    assert {r.file for r in exports.read(spark, out).select("file").collect()} == {f"{d}/again-{c}-a-r1.json" for d in ("quizzes", "sidecars", "instructions") for c in ("ag", "tp")}
    run = ["run-plan", *at("store", "topics", "models"), "--plan", f"{tmp_path}/run.yml", "--clients", f"{__name__}:client_roles"]
    assert cli.main([*run, "--topic", "Graphs"]) == 0 and cli.main(run) == 0
    assert capsys.readouterr().out.split("\n")[-3:-1] == ["2 new items", "2 new items"]
