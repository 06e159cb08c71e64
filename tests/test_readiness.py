"""What a run needs, told before it starts."""

import pytest

from lectern.operators.store import Store
from lectern.plans import cli, readiness
from lectern.sources import config, files, pdf

SWEEP = "{sweep: s, requests-file: r, configurations: [{id: a, approach: two-phase, generator: g, judge: j}]}"
REQUESTS = "- {key: a, course: PSE, competencies: [k1], language: en, question-types: [single-choice], number-of-questions: 2, difficulty: easy}\n"
TOPIC = "- {key: t, course: PSE, topic: Trees, language: en, question-types: [single-choice], number-of-questions: 2, difficulty: easy}\n"
MANIFEST = "course: {key: PSE, title: P}\ncompetencies:\n- {key: k1, title: T, lectureUnits: [{document: x/one.pdf}, {document: x/gone.pdf}]}\n"


def told(checks):
    return {c.name: c.status for c in checks}


def test_corpus_index_and_store(spark, tmp_path):
    assert told(readiness.corpus(spark, f"{tmp_path}/none")) == {"corpus": "BLOCKED"}
    (tmp_path / "c" / "x").mkdir(parents=True)
    assert told(readiness.corpus(spark, f"{tmp_path}/c")) == {"corpus": "BLOCKED"}
    (tmp_path / "c" / "x" / "one.pdf").write_bytes(pdf.simple(["a page"]))
    assert told(readiness.corpus(spark, f"{tmp_path}/c")) == {"corpus": "OK"}
    (tmp_path / "c" / "x" / "bad.pdf").write_bytes(b"nothing")
    found = readiness.corpus(spark, f"{tmp_path}/c")
    assert told(found) == {"corpus": "OK", "corpus files": "WARN"} and "1 of 2" in found[1].detail and readiness.ready(found)

    assert readiness.index(spark, f"file://{tmp_path}/index").status == "WARN"
    files.write_index(spark.createDataFrame([("c", [1.0])], "chunk_id string, embedding array<float>"), "f1", f"file://{tmp_path}/index")
    assert [readiness.index(spark, f"file://{tmp_path}/index", f).status for f in (None, "f1", "f2")] == ["OK", "OK", "WARN"]
    assert readiness.store(f"{tmp_path}/s").status == "WARN" and readiness.store(f"{tmp_path}/c").status == "OK"
    assert readiness.store(f"{tmp_path}/c/x/one.pdf").status == "BLOCKED"


def test_plans_and_courses(spark):
    plan, asked = config.sweep_plan(SWEEP), config.requests(REQUESTS + TOPIC)
    models = config.models("{backends: {x: {}}, models: {g: {backend: x}}}")
    prices = config.pricing("{models: {h: {billing: gpu-time}}}")
    assert told(readiness.plan(plan, models, prices, asked)) == {"models": "BLOCKED", "prices": "WARN", "requests": "BLOCKED"}
    models = config.models("{backends: {x: {}}, models: {g: {backend: x, model: h}, j: {backend: x, model: h}}}")
    assert told(readiness.plan(plan, models, prices, asked[:1])) == {"models": "OK", "prices": "OK", "requests": "OK"}
    manifest = config.manifest(MANIFEST)
    documents = spark.createDataFrame([("x/one.pdf",)], "document_id string")
    found = readiness.courses(asked, {"PSE": manifest}, documents)
    assert told(found) == {"competencies": "OK", "links": "WARN"} and "x/gone.pdf" in found[1].detail
    assert told(readiness.courses(asked, {}, documents))["competencies"] == "BLOCKED"


def test_doctor_puts_them_together(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    (tmp_path / "c" / "x").mkdir(parents=True)
    (tmp_path / "c" / "x" / "one.pdf").write_bytes(pdf.simple(["a page"]))
    for name, text in {"requests": REQUESTS, "manifest": MANIFEST, "sweep": SWEEP, "models": "{backends: {x: {}}, models: {g: {backend: x}, j: {backend: x}}}"}.items():
        (tmp_path / f"{name}.yml").write_text(text)
    every = [x for n in ("requests", "manifest", "sweep", "models") for x in (f"--{n}", f"file://{tmp_path}/{n}.yml")]
    assert cli.main(["doctor", *every, "--store", f"{tmp_path}/s", "--corpus", f"{tmp_path}/c"]) == 0
    out = capsys.readouterr().out
    assert "1 PDF files" in out and "x/gone.pdf" in out and "no price" in out
    assert cli.main(["doctor", *every, "--corpus", f"{tmp_path}/none"]) == 1
    assert Store(spark, f"{tmp_path}/s").read("run").count() == 0


@pytest.mark.parametrize("text", ["[", "sweep: s"])
def test_a_file_that_cant_be_used_is_told(spark, tmp_path, text):
    (tmp_path / "s.yml").write_text(text)
    checks, held = readiness.parsed(spark, {"sweep": f"file://{tmp_path}/s.yml"})
    assert told(checks)["sweep"] == "BLOCKED" and told(checks)["models"] == "WARN" and not held


def test_what_an_upload_may_hold():
    assert config.staged([("a/b.PDF", 5), ("x.zip", 7)]) == ["a/b.PDF", "x.zip"]
    assert config.staged([("a/b.pdf", 5), ("a/notes.txt", 1 << 40), ("y.zip", 3)], "x.zip") == ["a/b.pdf"]
    for files_, why in (([("../a.pdf", 1)], "leaves"), ([("a.txt", 1)], "only"), ([("a.pdf", 201 << 20)], "more than"), ([(f"{i}.pdf", 200 << 20) for i in range(11)], "together")):
        with pytest.raises(config.ConfigError, match=why):
            config.staged(files_)
    with pytest.raises(config.ConfigError, match="entries"):
        config.staged([("a.pdf", 1)] * 5001, "x.zip")
