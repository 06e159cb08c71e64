"""Plans: what must not be sorted, crossed or gathered isn't, and the reworked operators keep their edge cases."""

import hashlib

from lectern.operators import corpus, export, reports, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_deduplicated_by_digest(spark):
    rows = [("b", 1, "x" * 50), ("a", 2, "x" * 50), ("a", 1, "y" * 50), ("a", 3, "short"), ("c", 1, None), ("b", 2, "x" * 50)]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string")
    found = corpus.usable_pages(pages)
    assert sorted((r.document_id, r.page_number) for r in found.collect()) == [("a", 1), ("a", 2)]
    assert found.columns == pages.columns
    assert not [x for x in plan(found).splitlines() if ("Sort" in x or "hashpartitioning" in x) and "text" in x]


def test_chunks_of_a_long_document_take_one_pass(spark):
    pages = spark.range(5000).selectExpr("'d' as document_id", "cast(id + 1 as int) as page_number", "repeat('w', cast(id % 700 as int)) as text")
    found = corpus.chunk_numbers(pages.repartition(3), target=100, most=250)
    chunk = held = waiting = 0
    tokens = {r.page_number: r.t for r in pages.select("page_number", corpus.t.approx_tokens(corpus.t.utf16_length("text")).alias("t")).collect()}
    expected = {}
    for page in sorted(tokens):
        if tokens[page] >= 250:
            chunk += waiting > 0
        expected[page] = chunk
        if tokens[page] >= 250 or held + tokens[page] >= 100:
            chunk, held, waiting = chunk + 1, 0, 0
        else:
            held, waiting = held + tokens[page], waiting + 1
    assert {r.page_number: r.chunk for r in found.collect()} == expected
    assert "collect_list" not in plan(found)


def test_top_k_scores_blocks_and_keeps_ties(spark):
    rows = [(i, [1.0, float(i % 4)]) for i in range(40)] + [(40, [0.0, 0.0]), (41, [1.0]), (42, None)]
    index = spark.createDataFrame(rows, "chunk_ord long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, query_vector array<float>")
    found = retrieval.top_k(queries, index, 12)
    assert [r.chunk_ord for r in found.where("query_id = 7").orderBy("rank").collect()] == [*range(0, 40, 4), 41, 1]
    assert [(r.chunk_ord, r.score) for r in found.where("query_id = 8").orderBy("rank").collect()] == [(i, 0.0) for i in range(12)]
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    assert retrieval.top_k(queries.limit(0), index, 3).count() == 0


def test_threshold_sweep_counts_are_bounded_by_the_thresholds(spark):
    rows = [(i, m, 0.001 * ((i * 7 + m * 131) % 1000)) for i in range(300) for m in range(2)]
    s = spark.createDataFrame(rows, "item_id long, mode_ord int, severity double")
    s = s.selectExpr("item_id", "mode_ord", "case mode_ord when 0 then 'FACTUAL_ERROR' else 'OFF_TOPIC' end as mode", "severity")
    steps = [0.3, 0.0, 0.3, 1.0]  # in any order, with a repeat
    found = {r.step: r for r in reports.threshold_sweep(s, steps).collect()}
    worst = {i: max(0.001 * ((i * 7 + m * 131) % 1000) for m in range(2)) for i in range(300)}
    assert [found[k].accepted for k in range(4)] == [sum(1 - w >= x for w in worst.values()) for x in steps]
    assert all(r.total == 300 for r in found.values())


def test_fingerprint_of_rows_and_of_none(spark):
    rows = spark.range(500).selectExpr("id", "cast(id as string) as name").repartition(5)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(500)]
    assert tuple(export.fingerprint(rows, ["id"], ["name"]).first()) == (hashlib.sha256("\n".join(digests).encode()).hexdigest(), 500)
    assert tuple(export.fingerprint(rows.limit(0), ["id"], ["name"]).first()) == (hashlib.sha256().hexdigest(), 0)
