"""Places in hot groups, prefix matches and hash trees against plain Python, and how they are dealt out."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus, export, pool, prefixes, ranks


@pytest.fixture
def apart(spark):
    """Partitions stay as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_and_sums_in_a_hot_group(spark, apart):
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None, *(f"g{k}" for k in range(300))]), rng.randrange(10**6) * 6000 + i, rng.choice([None, 1, 5, 9]), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, o long, v long, i int").repartition(5)
    found = ranks.ranked(df, ["g"], ["o"], "v")
    groups, expected = {}, {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g in groups.values():
        s = 0
        for n, r in enumerate(sorted(g, key=lambda r: r[1]), 1):
            s += r[2] or 0
            expected[r[3]] = (n, len(g), s)
    assert {r.i: (r["__n"], r["__total"], r["__sum"]) for r in found.collect()} == expected
    assert found.columns == ["g", "o", "v", "i", "__n", "__total", "__sum"]
    # the group of a third of all rows was counted by several tasks, none of which had more than thrice the median
    dealt = sorted(df.repartitionByRange("g", "o").groupBy(F.spark_partition_id()).count().select("count").toPandas()["count"])
    assert dealt[-1] <= 3 * dealt[len(dealt) // 2] and len(dealt) == 12
    assert ranks.ranked(df.limit(0), ["g"], ["o"]).count() == 0
    assert sorted(r["__n"] for r in ranks.ranked(df, [], ["o"]).collect()) == list(range(1, 6001))


def test_places_where_a_group_of_several_batches_ends_inside_a_batch(spark):
    # 2,500 rows of one group fill two batches of 1,000; the third is shorter than what came before and begins another group
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        df = spark.range(2700).selectExpr("if(id < 2500, 'a', 'b') as g", "id as o", "id % 7 as v").coalesce(1)
        found = {r.o: (r["__n"], r["__total"], r["__sum"]) for r in ranks.ranked(df, ["g"], ["o"], "v").collect()}
        expected, s = {}, 0
        for i in range(2700):
            s = (0 if i == 2500 else s) + i % 7
            expected[i] = (i + 1, 2500, s) if i < 2500 else (i - 2499, 200, s)
        assert found == expected
        sizes = pool.batches(df, 12, ["g"], ["o"]).groupBy("g", "batch").count().collect()
        assert sum(r["count"] for r in sizes) == 2700 and len(sizes) == -(-2500 // 12) + -(-200 // 12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("n,parts", [(1, 1), (5, 4), (7, 3), (3, 5), (100, 7)])
def test_even_parts(spark, n, parts):
    of, at = ranks.evenly(F.col("id") + 1, F.lit(n), F.lit(parts))
    rows = spark.range(n).select(of.alias("of"), at.alias("at")).collect()
    sizes = [n // parts + (i < n % parts) for i in range(parts)]
    assert [(r.of, r["at"]) for r in rows] == [(i, k) for i, s in enumerate(sizes) for k in range(s)]


def test_batches_of_a_hot_cell(spark, apart):
    df = spark.range(1000).selectExpr("id", "if(id < 700, 'hot', concat('c', id % 9)) as cell")
    sizes = pool.batches(df, 12, ["cell"], ["id"]).groupBy("cell", "batch").count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and sum(r.cell == "hot" for r in sizes) == -(-700 // 12)
    assert {r["count"] for r in sizes if r.cell == "hot"} == {11, 12}


def test_prefixes_equal_startswith(spark, apart):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab/ü") for _ in range(rng.randrange(0, 9)))
    names = [*{word() for _ in range(150)}, "a", "b/x", None]
    strings = [*(word() + rng.choice(["", "#p1", "b"]) for _ in range(2500)), *["ab/a#p7"] * 900, *names, None]
    found = prefixes.beginnings(
        spark.createDataFrame([(s,) for s in strings], "string string").repartition(3), spark.createDataFrame([(n,) for n in names + names], "name string")
    )
    expected = {s: sorted((n for n in set(names) - {None} if s.startswith(n)), key=len) for s in set(strings) - {None}}
    assert {r.string: r.names for r in found.collect()} == {s: n for s, n in expected.items() if n}
    none = spark.createDataFrame([], "name string")
    assert prefixes.beginnings(spark.createDataFrame([("a",)], "string string"), none).count() == 0
    assert prefixes.beginnings(none.withColumnRenamed("name", "string"), spark.createDataFrame([("",)], "name string")).count() == 0


def test_touched_keys(spark):
    retrieved = spark.createDataFrame([("k1", "l/doc1.pdf#p1-2"), ("k2", "l/doc12.pdf#p1-2"), ("k3", "m/doc1.pdf#p1-2"), (None, "l/doc1"), ("k4", None)], "competency_key string, chunk_id string")
    changed = spark.createDataFrame([("l/doc1",), ("x",)], "document string")
    assert sorted(map(str, (r[0] for r in pool.touched(retrieved, changed).collect()))) == ["None", "k1", "k2"]


@pytest.mark.parametrize("n,fan", [(1, 3), (3, 3), (4, 3), (27, 3), (100, 3), (500, 1024)])
def test_hash_tree(spark, apart, n, fan):
    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            break
    rows = spark.range(n).selectExpr("id", "cast(id as string) as name").repartition(5)
    assert tuple(export.fingerprint(rows, ["id"], ["name"], fan).first()) == (level[0], n)


def exchanges(df):
    """Of a plan that has run: what each exchange carried, and how many rows."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            names = {p.output().apply(i).name() for i in range(p.output().size())}
            yield names, p.metrics().apply("shuffleRecordsWritten").value()
        kids = p.children()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [kids.apply(i) for i in range(kids.size())]
        for k in below:
            yield from walk(k)

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_only_candidates_are_shuffled_beyond_a_broadcast(spark):
    rows = [(f"d{i % 40}", i // 40, f"text {i if i % 10 else i % 70} " + "x" * 40) for i in range(2000)] + [("d0", 900, "short"), ("e", 1, None)]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string").repartition(6)
    first = {}
    for d, n, x in rows:
        if x and len(x) >= 40:
            first[x] = min(first.get(x, (d, n)), (d, n))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corpus.usable_pages(pages, sent=0)
        moved = [n for names, n in exchanges(found) if "text" in names and "__of" in names]
        assert sorted((r.document_id, r.page_number) for r in found.collect()) == sorted(first.values())
        seen = [x for _, _, x in rows if x and len(x) >= 40]
        again = sum(seen.count(x) > 1 for x in seen)
        assert moved and sum(moved) <= again + 5 < len(seen) / 2  # what the filter lets pass besides is rare
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.document_id, r.page_number) for r in corpus.usable_pages(pages).collect()) == sorted(first.values())
