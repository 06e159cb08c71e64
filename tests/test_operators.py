"""Operators on small literal inputs with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.functions import vectors as v
from lectern.operators import corpus, export, pool, quality, reports, retrieval, store
from lectern.schemas import FAILURE_MODES, thresholds


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def pages(spark, *ps):
    return spark.createDataFrame([(d, i, x) for d, i, x in ps], "document_id string, page_number int, text string")


def chunk_model(tokens, target, most):
    """Greedy packing as plain Python: lists of page indexes."""
    out, wait, held = [], [], 0
    for i, n in enumerate(tokens):
        if n >= most:
            out += [wait] if wait else []
            out.append([i])
            wait, held = [], 0
            continue
        wait.append(i)
        held += n
        if held >= target:
            out.append(wait)
            wait, held = [], 0
    return out + ([wait] if wait else [])


def test_chunks_merge_and_split(spark):
    p = pages(spark, *[("a.pdf", i + 1, "x" * 100) for i in range(6)])
    assert rows(corpus.chunks(p, 100, 400), "chunk_id") == [("a.pdf#p1-3",), ("a.pdf#p4-6",)]
    p = pages(spark, ("a.pdf", 1, "x" * 40), ("a.pdf", 2, "y" * 1600), ("a.pdf", 3, "z" * 40))
    c = corpus.chunks(p, 100, 400).collect()
    assert sorted(r.chunk_id for r in c) == ["a.pdf#p1-1", "a.pdf#p2-2", "a.pdf#p3-3"]


def test_chunks_follow_the_model(spark):
    rng = random.Random(4)
    docs = {f"d{k}.pdf": [rng.choice([0, 1, 30, 80, 200, 400, 900]) for _ in range(rng.randrange(1, 40))] for k in range(30)}
    p = pages(spark, *[(d, i + 1, "x" * n) for d, ns in docs.items() for i, n in enumerate(ns)])
    exp = []
    for d, ns in docs.items():
        for c in chunk_model([math.ceil(n / 2.38) for n in ns], 100, 300):
            exp.append((f"{d}#p{c[0] + 1}-{c[-1] + 1}", "\n\n".join("x" * ns[i] for i in c)))
    assert rows(corpus.chunks(p, 100, 300), "chunk_id", "text") == sorted(exp, key=repr)


def test_usable_pages_and_report(spark):
    long = "The rst page of the text is for everyone, end base included." + "x" * 10
    p = pages(spark, ("b/x.pdf", 1, long), ("a/1 deck.pdf", 2, long), ("a/1 deck.pdf", 1, "short"), ("a/1 deck.pdf", 3, "y" * 40), ("a/1 deck.pdf", 4, None))
    assert rows(corpus.usable_pages(p), "document_id", "page_number") == [("a/1 deck.pdf", 2), ("a/1 deck.pdf", 3)]
    r = {x.document_id: x for x in corpus.document_report(p).collect()}
    a = r["a/1 deck.pdf"]
    assert (a.role, a.pages, a.text_poor_pages, a.chars, a.approx_tokens, a.damaged_tokens, a.alt_text_lines, a.language) == ("LECTURE_DECK", 2, 1, 110, 47, 1, 1, "en")
    assert (r["b/x.pdf"].pages, r["b/x.pdf"].language, r["b/x.pdf"].role) == (0, "unknown", "OTHER")


def test_language_tie_goes_to_english(spark):
    assert [r[0] for r in spark.createDataFrame([(0, 0), (1, 1), (2, 1), (0, 3)], "g int, e int").select(t.language_of("g", "e")).collect()] == ["unknown", "en", "de", "en"]


def test_word_boundaries_are_ascii(spark):
    df = spark.createDataFrame([("für über-der derü der",)], "x string")
    assert df.select(t.marker_count("x", ("der",)), t.marker_count("x", ("für",))).first() == (3, 1)


def test_text_functions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    lit = F.lit
    assert one(t.strip(lit("  a  "))) == "a "
    assert one(t.utf16_length(lit("a\U0001f600"))) == 3
    assert one(t.approx_tokens(lit(5))) == 3 and one(t.approx_tokens(lit(None).cast("int"))) == 0
    assert one(t.to_query(lit("05 Linear__Programs   II "))) == "Linear Programs II"
    assert one(t.page_range(lit(4), lit(4))) == "Page 4" and one(t.page_range(lit(4), lit(6))) == "Pages 4–6"
    assert one(t.chunk_first_page(lit("a#b.pdf#p12-13"))) == 12 and one(t.chunk_first_page(lit("a#px-3"))) == 0 and one(t.chunk_first_page(lit("a"))) == 0
    assert one(t.chunk_document(lit("a#b.pdf#p1-2"))) == "a#b.pdf" and one(t.chunk_lecture(lit("x/a#p1-2"))) == "x" and one(t.chunk_lecture(lit("a"))) == ""
    assert one(t.cell_of(lit("c|k||single-choice|easy")))["language"] == ""
    with pytest.raises(Exception, match="not a cell key"):
        one(t.cell_of(lit("a|b")))
    assert one(t.objective(lit("T"), lit("- a\n\n  - b \nc"))) == "T — a b c" and one(t.objective(lit("T"), lit(" "))) == "T"
    assert one(t.retrieval_query(lit(""), lit("T"), lit("- a\n- b"))) == "T. a b"
    assert one(t.same_model(lit("m"), lit("m:latest"))) and not one(t.same_model(lit("m"), lit("mm")))
    assert one(t.manifest_lines(lit("a=1\nb=x=y\nnone\na=2"))) == {"a": "2", "b": "x=y"}
    assert [one(t.backoff_ms(lit(n))) for n in (1, 2, 6)] == [1000, 2000, 30000]
    assert one(t.slug_letters(lit(" Über die  Maße!"))) == "über-die-maße" and one(t.slug_ascii(lit("Ünï x"))) == "n-x" and one(t.slug_file(lit("a|b c"))) == "a-b-c"
    assert one(t.domain_of(lit("EIDI"))) == "java" and one(t.domain_of(lit("OR"))) == "or"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0, 9.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(v.cosine("a", "b")).collect()] == [0.0, round(25 / (5 * math.sqrt(106)), 6), 0.0]


def test_top_k_breaks_ties_by_order(spark):
    index = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)], "chunk_ord int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<float>")
    assert [r.chunk_ord for r in retrieval.top_k(q, index, 4).orderBy("rank").collect()] == [0, 2, 4, 1]


def test_interleave(spark):
    lists = [["a1", "a2", "a3"], ["b1"], ["c1", "c2", "a1"]]
    df = spark.createDataFrame([(p, r, c) for p, xs in enumerate(lists) for r, c in enumerate(xs)], "position int, rank int, chunk_id string")
    assert [r.chunk_id for r in retrieval.interleave(df).orderBy("place").collect()] == ["a1", "b1", "c1", "a2", "c2", "a3"]


def test_budget_keeps_the_first_and_stops(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([50, 30, 40, 5])] + [(2, 0, 500), (2, 1, 1)], "g int, place int, tokens long")
    assert rows(retrieval.within_budget(df, 90, ["g"]), "g", "place") == [(1, 0), (1, 1), (2, 0)]
    with pytest.raises(ValueError):
        retrieval.within_budget(df, 0, ["g"])


def test_grounding_block(spark):
    df = spark.createDataFrame([(1, 0, "L", "U", "Page 1", "text one"), (1, 1, "L", "U", None, "text two")], "g int, place int, source string, unit string, page_range string, text string")
    r = retrieval.grounding(df, 1000, ["g"]).first()
    assert r.block == f"{retrieval.BEGIN}\nLecture: L, Unit: U, Page 1\ntext one\n\nLecture: L, Unit: U\ntext two\n{retrieval.END}" and r.snippets == 2


def test_subsections(spark):
    ids = ["b.pdf#p5-6", "a.pdf#p9-9", "b.pdf#p2-3", "a.pdf#p1-2"]
    df = spark.createDataFrame([(i,) for i in ids], "chunk_id string")
    assert rows(retrieval.subsections(df, 2), "section", "chunk_id") == [(1, "a.pdf#p1-2"), (1, "a.pdf#p9-9"), (2, "b.pdf#p2-3"), (2, "b.pdf#p5-6")]
    five = spark.createDataFrame([(f"a#p{i}-{i}",) for i in range(5)], "chunk_id string")
    assert [r["count"] for r in retrieval.subsections(five, 3).groupBy("section").count().orderBy("section").collect()] == [2, 2, 1]


@pytest.mark.parametrize("n,size,exp", [(20, 12, [10, 10]), (5, 2, [2, 2, 1]), (1, 12, [1]), (25, 12, [9, 8, 8])])
def test_batches_are_even(spark, n, size, exp):
    df = spark.range(n).withColumn("cell", F.lit("c"))
    b = pool.batches(df, size, ["cell"], ["id"])
    assert [r["count"] for r in b.groupBy("batch").count().orderBy("batch").collect()] == exp
    assert b.where("batch_pos = 0").count() == len(exp)


def test_pool_growth(spark):
    cells = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2")], "competency_key string, cell_key string").select(F.concat("competency_key", "cell_key").alias("cell_key"), "competency_key")
    n = spark.createDataFrame([("ak1", 3), ("ck2", 4)], "cell_key string, n long")
    hit = spark.createDataFrame([("c",)], "competency_key string")
    assert rows(pool.targets(cells, n, hit, 2, True), "cell_key", "existing", "target") == [("ak1", 3, 3), ("bk1", 0, 2), ("ck2", 4, 6)]
    assert rows(pool.targets(cells, n, hit, 2, False), "cell_key", "target") == [("ak1", 3), ("bk1", 2), ("ck2", 4)]
    assert rows(pool.new_items(pool.targets(cells, n, hit, 2, True)), "cell_key", "item_index") == [("bk1", 0), ("bk1", 1), ("ck2", 4), ("ck2", 5)]


def test_touched_is_a_prefix_match(spark):
    got = spark.createDataFrame([("k", "x/a.pdf2#p1-1"), ("m", "x/b.pdf#p1-1"), ("n", "y")], "competency_key string, chunk_id string")
    changed = spark.createDataFrame([("x/a.pdf",), ("zzzzzzzzzzzzzzzzzzzzzzz",)], "document string")
    assert rows(pool.touched(got, changed), "competency_key") == [("k",)]


def test_changed_documents_ignore_deletions(spark):
    s = "document string, content_hash string"
    assert rows(pool.changed_documents(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], s), spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "4")], s)), "document") == [("b",), ("c",)]


def test_enqueue_and_ladder(spark):
    topics = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "position long, topic string")
    e = pool.enqueue_round_robin(topics, 5).withColumn("level", pool.ladder("item_index", [20, 80]))
    assert rows(e, "i", "topic", "item_index", "level") == [(0, "x", 0, 20), (1, "y", 0, 20), (2, "z", 0, 20), (3, "x", 1, 80), (4, "y", 1, 80)]


OPTS = "array<struct<text:string,correct:boolean>>"


def defect(spark, kind, title, text, opts):
    df = spark.createDataFrame([(kind, title, text, opts)], f"k string, t string, q string, o {OPTS}")
    return df.select(quality.defect_of(F.col("k"), F.col("t"), F.col("q"), F.col("o"))).first()[0]


GOOD = [("alpha", True), ("beta", False), ("gamma", False), ("delta", False)]


@pytest.mark.parametrize(
    "kind,title,text,opts,exp",
    [
        ("single-choice", "t", "q", GOOD, None),
        ("single-choice", " ", "q", GOOD, "BLANK_TEXT"),
        ("single-choice", "t", None, GOOD, "BLANK_TEXT"),
        ("single-choice", "t", "Look at the following table.", GOOD, "DANGLING_REFERENCE"),
        ("single-choice", "t", "Das GEGEBENEN Netzwerk hat", GOOD, "DANGLING_REFERENCE"),
        ("single-choice", "t", "Look at the following table:\n1 2", GOOD, None),
        ("single-choice", "t", "Which of the following options holds?", GOOD, None),
        ("single-choice", "t", "q", GOOD[:3], "OPTION_COUNT"),
        ("true-false", "t", "q", GOOD[:2], None),
        ("single-choice", "t", "q", [*GOOD[:3], (" ", False)], "BLANK_OPTION"),
        ("single-choice", "t", "q", [*GOOD[:3], ("ALPHA", False)], "DUPLICATE_OPTIONS"),
        ("single-choice", "t", "q", [*GOOD[:3], ("None of the above", False)], "BANNED_CONSTRUCTION"),
        ("single-choice", "t", "q", [*GOOD[:3], ("both a and c", False)], "BANNED_CONSTRUCTION"),
        ("single-choice", "t", "q", [*GOOD[:3], ("the alpha case", False)], "CONTAINED_OPTION"),
        ("single-choice", "t", "q", [("2", True), ("12", False), ("21", False), ("122", False)], None),
        ("single-choice", "t", "q", [("f(x)", True), ("f(x) + 1", False), ("c", False), ("d", False)], None),
        ("single-choice", "t", "q", [("a.*", True), ("axx b", False), ("c", False), ("d", False)], None),
        ("single-choice", "t", "q", [("alpha", True), ("beta", True), ("gamma", False), ("delta", False)], "CORRECT_COUNT"),
        ("multiple-choice", "t", "q", [(x, True) for x, _ in GOOD], "CORRECT_COUNT"),
        ("multiple-choice", "t", "q", [(x, x != "delta") for x, _ in GOOD], None),
        ("single-choice", "t", "q", [("a" * 40, True), ("b" * 20, False), ("c", False), ("d", False)], "CONSPICUOUS_LENGTH"),
        ("single-choice", "t", "q", [("a" * 39, True), ("b" * 20, False), ("c", False), ("d", False)], None),
    ],
)
def test_defects(spark, kind, title, text, opts, exp):
    assert defect(spark, kind, title, text, opts) == exp


def test_gate(spark):
    s = spark.createDataFrame([(1, "FACTUAL_ERROR", 0.3), (1, "OFF_TOPIC", 0.9), (2, "OFF_TOPIC", 0.0)], "item_id int, mode string, severity double")
    assert rows(quality.decide(s, 0.7, ("FACTUAL_ERROR",)), "item_id", "accepted") == [(1, True), (2, True)]
    assert rows(quality.decide(s, 0.7), "item_id", "accepted") == [(1, False), (2, True)]
    with pytest.raises(ValueError, match="nothing could ever reject"):
        quality.gate_of(("DIFFICULTY_MISMATCH",), "GENERAL")


def test_thresholds_are_accumulated(spark):
    ts = thresholds()
    assert len(ts) == 21 and ts[14] == 0.7000000000000001 and ts[20] == 1.0000000000000002
    s = spark.createDataFrame([(1, "OFF_TOPIC", 0.3), (2, "OFF_TOPIC", 0.0), (2, "FACTUAL_ERROR", 0.0)], "item_id int, mode string, severity double")
    r = {x.step: x for x in reports.threshold_sweep(s).collect()}
    # a severity of 0.3 passes the gate at 0.7 but not the sweep's row, and a flawless item fails the last row
    assert r[14].accepted == 1 and r[13].accepted == 2 and r[20].accepted == 0 and r[20].worst_factual_error == 1
    assert quality.decide(s, 0.7).where("item_id = 1").first().accepted


def test_verdicts_are_tidied(spark):
    full = [(1, i, m.lower().replace("_", "-") + " ", 2.0 if i == 0 else None, None) for i, m in enumerate(FAILURE_MODES[:5])] + [(1, 9, "Off Topic", -1.0, True), (1, 10, "bogus", 1.0, True)]
    part = [(2, i, m, 0.1, False) for i, m in enumerate(FAILURE_MODES[:4])] + [(2, 8, "DIFFICULTY_MISMATCH", 0.1, False)]
    df = spark.createDataFrame(full + part, "item_id int, ord int, mode string, severity double, triggered boolean")
    r = rows(quality.normalise_verdicts(df, "GENERAL", ["item_id"]), "item_id", "mode", "severity", "triggered")
    assert len(r) == 5 and (1, "FACTUAL_ERROR", 1.0, False) in r and (1, "OFF_TOPIC", 0.0, True) in r


def test_selection(spark):
    chosen = spark.createDataFrame([(1, p, i) for p, i in enumerate([7, 3, 7, None, 99, 5, 4])], "r int, pos int, id long")
    known = spark.createDataFrame([(1, i) for i in (3, 4, 5, 7)], "r int, id long")
    assert rows(quality.clean_selection(chosen, known, 3, ["r"]), "rank", "id") == [(1, 7), (2, 3), (3, 5)]


def test_rejected_texts_block_their_repeats(spark):
    df = spark.createDataFrame([(1, 0, "A  b", False), (1, 1, "a B", True), (1, 2, "c", True), (1, 3, "d", True), (1, 4, "e", True)], "g int, i int, text string, would_accept boolean")
    assert [r.status for r in quality.accept_in_order(df, 2, ["g"], ["i"]).orderBy("i").collect()] == ["rejected", "duplicate", "accepted", "accepted", "unjudged"]


def test_rounds_end_at_the_first_judged_one_without_gain(spark):
    df = spark.createDataFrame([(1, 1, True, 0), (1, 2, False, 2), (1, 3, False, 0), (1, 4, False, 1)], "g int, round int, failed boolean, accepted int")
    assert rows(quality.rounds_run(df, ["g"]), "round") == [(1,), (2,), (3,)]


PRICES = [("m", "tokens", 2.0, 10.0), ("g", "gpu-time", 0.0, 0.0)]


def test_costs(spark):
    p = spark.createDataFrame(PRICES, "model string, billing string, input_eur double, output_eur double")
    c = spark.createDataFrame([("x", "m", 1_000_000, 500_000, 5), ("y", "g", 9, 9, 3_600_000), ("y", "m", None, None, 1), ("z", "?", 5, 5, 5)], "k string, model string, prompt_tokens long, completion_tokens long, wall_clock_ms long")
    r = {x.k: x for x in reports.cost(c, p, ["k"], 0.08, 1.2).collect()}
    assert (r["x"].low_eur, r["x"].high_eur, r["x"].exact) == (7.0, 7.0, True)
    assert (r["y"].low_eur, r["y"].high_eur, r["y"].exact, r["y"].prompt_tokens) == (0.08, 1.2, False, 0)
    assert r["z"].unpriced_models == "?" and r["z"].high_eur == 0


def test_unregistered_runs_cost_nothing_and_no_accepted_is_null(spark):
    items = spark.createDataFrame([(1, "r", "a", "FILTERED", True), (2, "r", "a", "FILTERED", False), (3, "pool", "a", "FILTERED", True), (4, "r", "b", "FAILED_FILTER", None), (5, "r", "c", "PENDING", None)], "item_id int, run_id string, configuration_id string, state string, accepted boolean")
    calls = spark.createDataFrame([(i, "m", 1_000_000, 0, 1) for i in (1, 3, 4)], "item_id int, model string, prompt_tokens long, completion_tokens long, wall_clock_ms long")
    p = spark.createDataFrame(PRICES, "model string, billing string, input_eur double, output_eur double")
    r = rows(reports.cost_per_configuration(items, spark.createDataFrame([("r",)], "run_id string"), calls, p, 0.08, 1.2), "configuration_id", "items", "accepted", "failed", "low_eur", "per_accepted_low")
    assert r == [("a", 2, 1, 0, 2.0, 2.0), ("b", 0, 0, 1, 2.0, None)]


def test_amortisation(spark):
    conf = spark.createDataFrame([(0, "ag", "agentic", "l", "m", "m"), (1, "tp", "two-phase", "l", "m", "g"), (2, "tq", "two-phase", "l", "m", "m")], "ord int, configuration_id string, approach string, generator string, generator_model string, judge_model string")
    per = spark.createDataFrame([("ag", 1, 2.0), ("tp", 1, 0.2), ("tq", 2, 3.0)], "configuration_id string, quizzes int, mid_per_quiz double")
    pools = spark.createDataFrame([("l", "m", 1.0, 1.0), ("l", "g", 0.18, 1.78), ("l", "other", 9.0, 9.0)], "generator string, model string, low_eur double, high_eur double")
    r = {x.configuration_id: x for x in reports.amortisation(conf, per, pools).collect()}
    assert r["tp"].pool_mid == pytest.approx(1.98) and r["tp"].break_even == 2 and r["tq"].break_even == -1 and r["tq"].pool_mid == 1.0


def test_every_pool_carries_all_verdict_calls(spark):
    s = "generator string, model string, prompt_tokens long, completion_tokens long, wall_clock_ms long"
    p = spark.createDataFrame(PRICES, "model string, billing string, input_eur double, output_eur double")
    own = spark.createDataFrame([("a", "m", 1_000_000, 0, 1)], s)
    verdicts = spark.createDataFrame([("a", "m", 500_000, 0, 1), ("b", "g", None, None, 3_600_000)], s)
    gens = spark.createDataFrame([("a",), ("b",)], "generator string")
    assert rows(reports.pool_cost(own, verdicts, gens, p, 0.1, 1.0), "generator", "model", "low_eur") == [("a", "g", 0.1), ("a", "m", 3.0), ("b", "g", 0.1), ("b", "m", 1.0)]
    assert rows(reports.pool_cost(own, verdicts, gens, p, 0.1, 1.0, scoped=True), "generator", "model", "low_eur") == [("a", "m", 3.0), ("b", "g", 0.1)]


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0.0, 0.01, 0.25, 0.26, 0.5, 0.51, 1.0)], "f double")
    assert [r[0] for r in df.select(reports.bucket_of(F.col("f"))).collect()] == ["0%", "0%", "1-25%", "1-25%", "26-50%", "26-50%", ">50%", ">50%"]


def test_progress(spark):
    df = spark.createDataFrame([("r", s) for s in ("PENDING", "FILTERED", "FAILED_FILTER", "FILTERING", "GENERATED", "GENERATING", "FILTERED")] + [("q", "FILTERED")], "run_id string, state string")
    r = {x.run_id: x for x in reports.progress(df, ["run_id"]).collect()}["r"]
    assert (r.total, r.done, r.awaiting_judge, r.to_generate, r.failed, r.percent, r.complete) == (7, 2, 2, 2, 1, 42, False)


def test_transitions(spark):
    df = spark.createDataFrame([(1, "GENERATING", 0, 0, None), (2, "FILTERING", 1, 2, None), (3, "FAILED_GENERATION", 3, 0, "TIMEOUT"), (4, "FAILED_FILTER", 1, 3, "RATE_LIMIT"), (5, "FAILED_FILTER", 1, 3, "FILTER_NO_MODES")], "i int, state string, generation_attempts int, filter_attempts int, failure string")
    assert rows(df.select("i", store.released(F.col("state")).alias("s")), "i", "s")[:2] == [(1, "PENDING"), (2, "GENERATED")]
    assert rows(store.revive(df), "i", "state", "generation_attempts", "filter_attempts", "failure") == [(3, "PENDING", 0, 0, None), (4, "GENERATED", 1, 0, None)]
    down = df.where("i <= 2").withColumns(store.after_failure(F.lit("X"), F.col("i") == 1))
    assert rows(down, "i", "state", "generation_attempts", "filter_attempts") == [(1, "PENDING", 1, 0), (2, "FAILED_FILTER", 1, 3)]
    up = df.where("i = 2").withColumns(store.after_success("FILTERING")).first()
    assert (up.state, up.filter_attempts) == ("FILTERED", 3)


def test_final_quizzes(spark):
    df = spark.createDataFrame([(0, ["TRANSPORT"]), (0, [None]), (3, ["TRANSPORT"]), (0, ["AUTH"]), (0, None)], "n int, c array<string>")
    assert [r[0] for r in df.select(store.final_quiz(F.col("n"), F.col("c"))).collect()] == [False, True, True, True, True]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    items = spark.createDataFrame([(1, "r", "c", "t", 0), (2, "r", "c", "t", 1), (2, "r", "c", "t", 1)], "item_id long, run_id string, configuration_id string, topic_key string, item_index int")
    assert s.enqueue(items) == 2 and s.enqueue(items) == 0
    s.append("item", s.read("item").where("item_id = 1").withColumn("state", F.lit("GENERATING")).withColumns(store.after_success("GENERATING")))
    assert rows(s.read("item"), "item_id", "state", "generation_attempts") == [(1, "GENERATED", 1), (2, "PENDING", 0)]
    v = lambda ok: spark.createDataFrame([(1, "j", "GENERAL", ok)], "item_id long, judge_model string, scope string, accepted boolean")
    s.append("verdict", v(True))
    s.append("verdict", v(False))
    assert rows(s.read("verdict"), "item_id", "accepted") == [(1, False)]
    q = lambda i, r, n: spark.createDataFrame([(i, "r", "c", r, 1, n)], "quiz_id string, run_id string, configuration_id string, request_key string, repetition int, candidate_count int")
    for x in (q("a", "r1", 1), q("b", "r1", 2), q("b", "r2", 3), q("c", "r3", 4)):
        s.append("quiz", x)
    assert rows(s.read("quiz"), "quiz_id", "request_key", "candidate_count") == [("b", "r2", 3), ("c", "r3", 4)]
    d = lambda h: spark.createDataFrame([("c", "01_Introduction", h)], "course_key string, document string, content_hash string")
    s.append("document", d("aaa"))
    s.append("document", d("ccc"))
    assert rows(s.read("document"), "content_hash") == [("ccc",)]
    s.register("r", "c", "m")
    s.register("r", "c", "m")
    assert s.read("run").count() == 1
    with pytest.raises(ValueError, match="another manifest"):
        s.register("r", "c", "n")


def test_exports(spark, tmp_path):
    q = spark.createDataFrame([(1, 5, "second", "k2"), (1, 2, "first", None), (2, 1, "lost", "k1")], "quiz_id long, q_index long, text string, competency_key string")
    quizzes = spark.createDataFrame([(1, "r1", "conf"), (2, "gone", "conf")], "quiz_id long, request_key string, configuration_id string")
    req = spark.createDataFrame([("r1", "PSE", "en", "all", "APPLY")], "request_key string, course_key string, language string, objectives string, bloom string")
    comp = spark.createDataFrame([("PSE", "k2", "K", "- do", "CREATE")], "course_key string, competency_key string, title string, description string, taxonomy string")
    p = export.public_questions(q, quizzes, req, comp)
    assert rows(p, "question_id", "question", "learning_objective", "bloom_intended", "domain") == [("1-q0", "first", "all", "APPLY", "se"), ("1-q1", "second", "K — do", "CREATE", "se")]
    assert not {"generator_id", "explanation", "decision"} & set(p.columns)
    assert rows(export.hidden_questions(q, quizzes), "question_id", "generator_id")[0] == ("1-q0", "conf")
    items = spark.createDataFrame([("c1", "r1", "t a", True, 20, ["L"]), ("c1", "r2", "t a", False, 80, ["L", ""]), ("c1", "r2", "t a", None, 80, ["M"])], "configuration_id string, run_id string, topic_key string, accepted boolean, requested_difficulty int, lectures array<string>")
    g = rows(export.item_groups(items, "topic", "split"), "quiz_id", "item_count", "run_ids", "difficulty", "source_material")
    assert g == [("t-a__accepted", 1, "r1", "easy", "L"), ("t-a__rejected", 2, "r2", "hard", ".")]
    assert rows(export.item_groups(items, "run", "accepted"), "quiz_id") == [("r1__accepted",)]
    export.write_quiz_files(export.item_groups(items, "topic", "split"), f"{tmp_path}/q")
    assert spark.read.json(f"{tmp_path}/q").count() == 2
    a, b = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, sha256 string"), spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "3")], "path string, sha256 string")
    assert rows(export.manifest_diff(a, b), "path", "status") == [("w", "extra"), ("y", "differs"), ("z", "missing")]


def test_browse_and_candidates(spark):
    items = spark.createDataFrame([(i, f"2024-01-0{i}", "t", True) for i in range(1, 5)], "item_id int, updated_at string, topic_key string, accepted boolean").withColumn("updated_at", F.to_timestamp("updated_at"))
    att = spark.createDataFrame([(4,), (4,), (1,)], "item_id int")
    assert [(r.item_id, r.attempts) for r in store.browse(items, att, 2, topic="t").orderBy("item_id").collect()] == [(3, 0), (4, 2)]
    verdicts = spark.createDataFrame([(1, "local", "GENERAL", True), (2, "local", "GENERAL", False), (2, "cloud", "GENERAL", True)], "item_id int, judge_model string, scope string, accepted boolean")
    assert rows(pool.candidates(items, verdicts, "local", {"topic_key": "t"}), "item_id") == [(1,)] and rows(pool.candidates(items, verdicts, "cloud", {}), "item_id") == [(2,)]
    assert pool.candidates(items, verdicts, "local", {}, "1970-01-01").count() == 0
    assert rows(pool.missing_verdicts(items, verdicts, "local"), "item_id") == [(3,), (4,)]


def test_sweep_export_and_results(spark, tmp_path):
    q = spark.createDataFrame([(1, 0, "first", "k"), (2, 0, "lost", None)], "quiz_id long, q_index long, text string, competency_key string")
    quizzes = spark.createDataFrame([(1, "r1", "conf"), (2, "gone", "conf"), (3, "r1", "conf")], "quiz_id long, request_key string, configuration_id string")
    req = spark.createDataFrame([("r1", "PSE", "de", "all", "APPLY")], "request_key string, course_key string, language string, objectives string, bloom string")
    comp = spark.createDataFrame([("PSE", "k", "K", "- do", "CREATE")], "course_key string, competency_key string, title string, description string, taxonomy string")
    export.sweep_export(quizzes, q, req, comp, str(tmp_path))
    for part in ("quizzes", "sidecars", "instructions"):
        assert [r.quiz_id for r in spark.read.json(f"{tmp_path}/{part}").collect()] == [1]
    assert spark.read.json(f"{tmp_path}/instructions").first().language == "German"
    res = spark.createDataFrame([(1, "1-q0", "m", 50.0, True), (1, "1-q0", "m", 100.0, False), (1, None, "c", 70.0, True)], "quiz_id long, question_id string, metric_name string, score double, applicable boolean")
    side = export.hidden_questions(q, quizzes)
    assert rows(export.score_summary(export.join_results(res, side)), "generator_id", "metric_name", "mean_score") == [("conf", "m", 50.0)]
    assert rows(export.score_summary(export.join_results(res, side, "quiz")), "metric_name", "mean_score") == [("c", 70.0)]
    import yaml

    c = yaml.safe_load(export.evaluator_config("x", {"a": "1.0", "b": "2.0"}, ("b",)))
    assert [m["enabled"] for m in c["metrics"]] == [True, False]


def test_sinks(spark, tmp_path):
    opts = spark.createDataFrame([("b", 0, "T2", "q2", GOOD), ("a", 1, "T1", "q1", GOOD)], f"topic_key string, item_index int, title string, question_text string, options {OPTS}")
    export.write_items_markdown(opts, f"{tmp_path}/md")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/md").collect())
    assert text.index("## T1") < text.index("## T2") and "- [correct] alpha" in text
    for _ in range(2):  # replaced, not appended
        export.write_jsonl(opts, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    export.write_csv(spark.createDataFrame([('a"b', 1)], "id string, n int"), f"{tmp_path}/csv")
    assert '"a""b","1"' in [r.value for r in spark.read.text(f"{tmp_path}/csv").collect()]
    ids = export.item_ids(opts, [], ["topic_key"])
    assert rows(ids, "question_id", "title") == [("q1", "T1"), ("q2", "T2")]
    assert rows(corpus.grounded(spark.createDataFrame([("a", 0), ("b", 2)], "topic string, chunks int")), "topic") == [("b",)]
    calls = spark.createDataFrame([([("success",)],), ([("success",), ("error",)],), (None,)], "c array<struct<outcome:string>>")
    assert [r[0] for r in calls.select(store.storable_quiz(F.col("c"))).collect()] == [True, False, True]
    roles = spark.createDataFrame([(1, "TUTORIAL"), (1, "TUTORIAL"), (1, None)], "g int, role string")
    assert retrieval.role_counts(roles, ["g"]).first().counts_by_role == {"TUTORIAL": 2}
