"""Every registered query that SQL can express gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.fixtures import TABLES
from lectern.plans import catalogue, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def tidy(x):
    if x is None or x != x:
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_equal_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(tidy(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_batch_plan_of_cells_beyond_an_arrow_batch(spark, tmp_path):
    # cells of hundreds of rows reach a task in batches of a hundred, and end inside one
    p = f"{tmp_path}/orders.parquet"
    spark.range(4000).selectExpr(
        "id as o_orderkey", "if(id % 10 < 7, 0, 4 * (id % 3)) as o_custkey", "if(id % 11 = 0, 'F', 'O') as o_orderstatus", "cast(id as double) as o_totalprice",
        "timestamp'2026-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority",
    ).write.parquet(p)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{p}/*.parquet')")
    cols = "item_id, competency_key, language, batch, batch_pos"
    theirs = con.execute(f"SELECT {cols} FROM ({entry.oracle_sql()['batch_plan']}) ORDER BY item_id").fetchall()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        mine = entry.queries()["batch_plan"](spark, str(tmp_path)).select(*cols.split(", ")).orderBy("item_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in mine] == theirs and len(theirs) == sum(i % 11 > 0 for i in range(4000))


def test_every_catalogue_query_has_sql():
    assert set(catalogue.QUERIES) == set(oracle.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
