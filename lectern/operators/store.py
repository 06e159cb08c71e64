"""The store: append-only Parquet tables with latest-wins views.

A change is a new version of a row. ``version`` orders them; ties are broken by ``batch``, the name of the write, and inside
one by ``row``, a number given when it was written, so a view is the same on every read. Keys are compared null-safely by
grouping.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ITEM_KEY, TABLES, TRANSIENT_FAILURES


def latest(versions: DataFrame, key: list[str], order: str = "version") -> DataFrame:
    """The newest version of each key: one aggregation, partial on the map side."""
    rest = [c for c in versions.columns if c not in key]
    pick = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), _when(versions, order)).alias("__r"))
    return pick.select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in versions.columns])


def latest_by_either(versions: DataFrame, first: list[str], second: list[str], order: str = "version") -> DataFrame:
    """Rows that no newer row replaces on either key: a write replaces what it meets on the one or the other.

    A row survives if it is the newest of both its keys. (A row that was itself replaced still replaced older ones.)
    """
    put = versions.withColumn("__when", _when(versions, order))
    for key in (first, second):
        last = versions.withColumn("__when", _when(versions, order)).groupBy(*key).agg(F.max("__when").alias("__when"))
        both = zip([*key, "__when"], last.columns)
        put = put.join(last.toDF(*[f"__{c}" for c in last.columns]), reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{x}")) for c, x in both]), "left_semi")
    return put.drop("__when")


def _when(versions: DataFrame, order: str) -> Column:
    """When a row was written, as far as the columns tell."""
    return F.struct(F.col(order), *[F.coalesce(c, F.lit(d)) for c, d in (("batch", ""), ("row", 0)) if c in versions.columns])


def enqueue(existing: DataFrame, new: DataFrame, key: list[str] | tuple[str, ...] = ITEM_KEY) -> DataFrame:
    """The rows of ``new`` whose key isn't there yet, each key once: what an insert-or-ignore creates."""
    return new.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def register(existing: DataFrame, run_id: str, manifest: str) -> bool:
    """Whether the run is new; an error if it is known under another manifest."""
    was = existing.where(F.col("run_id") == run_id).select("manifest").limit(1).collect()
    if was and was[0].manifest != manifest:
        raise ValueError(f"run {run_id!r} is registered with another manifest; use a new name or restore the inputs")
    return not was


def after_success(stage: str) -> dict[str, Column]:
    """Columns of the next version of an item whose ``stage`` (GENERATING, FILTERING) succeeded."""
    done, counter = ("GENERATED", "generation_attempts") if stage == "GENERATING" else ("FILTERED", "filter_attempts")
    return {"state": F.lit(done), counter: F.col(counter) + 1, "failure": F.lit(None).cast("string")}


def failure_state(stage: Column, retry: Column) -> Column:
    """Where a failed attempt leaves an item: one stable state back, or failed for good."""
    generating = stage == "GENERATING"
    return F.when(retry, F.when(generating, "PENDING").otherwise("GENERATED")).otherwise(F.when(generating, "FAILED_GENERATION").otherwise("FAILED_FILTER"))


def after_failure(failure: Column, retry: Column) -> dict[str, Column]:
    """Columns of the next version of an item that failed in its state."""
    s = F.col("state")
    one = lambda at, c: F.col(c) + (s == at).cast("int")
    return {"state": failure_state(s, retry), "failure": failure, "generation_attempts": one("GENERATING", "generation_attempts"), "filter_attempts": F.col("filter_attempts") + (s != "GENERATING").cast("int")}


def may_retry(attempts: Column, most: int, category: Column | None = None) -> Column:
    """Another attempt is left, and (where a category is given) the failure isn't permanent."""
    ok = attempts + 1 < most
    return ok if category is None else ok & ~F.coalesce(category.isin("AUTH", "BAD_REQUEST"), F.lit(False))


def released(state: Column) -> Column:
    """The state after a restart: claimed items go back."""
    return F.when(state == "GENERATING", "PENDING").when(state == "FILTERING", "GENERATED").otherwise(state)


def revive(items: DataFrame) -> DataFrame:
    """Items failed for good on timeouts, transport or throttling, back in the queue with that stage's counter at 0."""
    lost = F.col("state").isin("FAILED_GENERATION", "FAILED_FILTER") & F.col("failure").isin(*TRANSIENT_FAILURES)
    gen = F.col("state") == "FAILED_GENERATION"
    return items.where(lost).withColumns({
        "generation_attempts": F.when(gen, 0).otherwise(F.col("generation_attempts")), "filter_attempts": F.when(gen, F.col("filter_attempts")).otherwise(0),
        "state": F.when(gen, "PENDING").otherwise("GENERATED"), "failure": F.lit(None).cast("string"),
    })


def final_quiz(questions: Column, categories: Column) -> Column:
    """A quiz counts as answered if it has a question, or if no call of it failed for a passing reason."""
    return (questions > 0) | ~F.coalesce(F.exists(categories, lambda c: F.coalesce(c.isin(*TRANSIENT_FAILURES), F.lit(False))), F.lit(False))


def storable_quiz(calls: Column) -> Column:
    """No call failed."""
    return ~F.coalesce(F.exists(calls, lambda c: c["outcome"] != "success"), F.lit(False))


def work_list(configurations: DataFrame, requests: DataFrame, repetitions: int, final: DataFrame) -> DataFrame:
    """Quizzes still to make: configurations x requests x 1..repetitions, less those that are final."""
    every = configurations.crossJoin(requests).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    return every.join(final.select("configuration_id", "request_key", "repetition"), ["configuration_id", "request_key", "repetition"], "left_anti")


def sweep_status(configurations: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Stored quizzes of each configuration, 0 without any."""
    n = quizzes.groupBy("configuration_id").agg(F.count(F.lit(1)).alias("quizzes"))
    return configurations.join(n, "configuration_id", "left").withColumn("quizzes", F.coalesce("quizzes", F.lit(0)))


def browse(items: DataFrame, attempts: DataFrame, most: int = 100, run_id: str | None = None, topic: str | None = None, accepted: bool | None = None) -> DataFrame:
    """The newest items that have a body, with their number of attempts; optional predicates reach the scan."""
    for c, v in (("run_id", run_id), ("topic_key", topic), ("accepted", accepted)):
        if v is not None:
            items = items.where(F.col(c) == v)
    top = items.orderBy(F.desc("updated_at"), "item_id").limit(most)
    n = attempts.join(top.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("attempts"))
    return top.join(n, "item_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def by_approach(rows: DataFrame, approach: str, column: str = "configuration_id") -> DataFrame:
    """Rows of configurations of an approach: the id begins with it and a bar."""
    return rows.where(F.col(column).startswith(f"{approach}|"))


def next_claim(items: DataFrame, n: int = 1) -> DataFrame:
    """The next items to work on: generated ones before pending ones, then by topic and index."""
    return items.where(F.col("state").isin("GENERATED", "PENDING")).orderBy(F.when(F.col("state") == "GENERATED", 0).otherwise(1), "topic_key", "item_index").limit(n)


class Store:
    """Tables of :data:`lectern.schemas.TABLES` as Parquet folders under ``root``, plus ``version``, ``batch`` and ``row``."""

    KEYS = {"run": ["run_id"], "item": list(ITEM_KEY), "verdict": ["item_id", "judge_model", "scope"], "document": ["course_key", "document"]}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _schema(self, table: str) -> T.StructType:
        return T.StructType([*TABLES[table].fields, T.StructField("version", T.LongType()), T.StructField("batch", T.StringType()), T.StructField("row", T.LongType())])

    def _there(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def versions(self, table: str) -> DataFrame:
        if not self._there(table):
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(f"{self.root}/{table}")

    def read(self, table: str) -> DataFrame:
        """The current rows."""
        v = self.versions(table)
        if table == "quiz":
            v = latest_by_either(v, ["quiz_id"], ["run_id", "configuration_id", "request_key", "repetition"])
        elif table in self.KEYS:
            v = latest(v, self.KEYS[table])
        return v.drop("version", "batch", "row")

    def append(self, table: str, rows: DataFrame) -> None:
        """New versions of rows; columns that ``rows`` lacks are null."""
        version = int(self.versions(table).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) + 1
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields]
        mark = [F.lit(version).cast("long").alias("version"), F.lit(uuid.uuid4().hex).alias("batch"), F.monotonically_increasing_id().alias("row")]
        rows.select(*cols, *mark).write.mode("append").parquet(f"{self.root}/{table}")

    def enqueue(self, items: DataFrame) -> int:
        """Create items that aren't there; how many were."""
        new = enqueue(self.read("item"), items).withColumns({"state": F.lit("PENDING"), "generation_attempts": F.lit(0), "filter_attempts": F.lit(0)})
        n = new.count()
        if n:
            self.append("item", new)
        return n

    def register(self, run_id: str, configuration_id: str, manifest: str) -> None:
        if register(self.read("run"), run_id, manifest):
            self.append("run", self.spark.sql("select current_timestamp() as created_at").withColumns({"run_id": F.lit(run_id), "configuration_id": F.lit(configuration_id), "manifest": F.lit(manifest)}))
