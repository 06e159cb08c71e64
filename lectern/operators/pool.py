"""Pool operators: grid, incremental growth, batches, judging work lists, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .prefixes import beginnings
from .ranks import evenly, ranked

CELL = ["course_key", "competency_key", "language", "question_type", "difficulty_band"]


def grid(competencies: DataFrame, languages: DataFrame, types: DataFrame, difficulties: DataFrame) -> DataFrame:
    """Every cell, in order of competency, language, type and difficulty (each input has an ``ord``); adds ``cell_key`` and
    ``position``. All but the competencies are small dimensions."""
    sides = [competencies.withColumnRenamed("ord", "o1"), languages.withColumnRenamed("ord", "o2"), types.withColumnRenamed("ord", "o3"), difficulties.withColumnRenamed("ord", "o4")]
    out = sides[0]
    for s in sides[1:]:
        out = out.crossJoin(F.broadcast(s))  # a few languages, types or difficulties
    out = ranked(out, [], ["o1", "o2", "o3", "o4"]).withColumnRenamed("__n", "position")
    return out.withColumn("cell_key", t.cell_key(*CELL)).drop("o1", "o2", "o3", "o4", "__total", "__sum")


def changed_documents(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``document`` of every hash that is new or differs; documents that went away are not told."""
    p = previous.select("document", F.struct(F.col("content_hash").alias("hash")).alias("was"))
    same = F.col("was").isNotNull() & F.col("content_hash").eqNullSafe(F.col("was.hash"))
    return current.join(p, "document", "left").where(~same).select("document")


def touched(retrieved: DataFrame, changed: DataFrame, key: str = "competency_key") -> DataFrame:
    """Keys whose retrieved chunks come from a changed document: the chunk id begins with the document's name. Distinct ids and
    names are swept in order; each goes to one task once, however many lengths the names have."""
    ids = retrieved.select(key, "chunk_id").distinct()
    hit = beginnings(ids.select(F.col("chunk_id").alias("string")), changed.select(F.col("document").alias("name")))
    return ids.join(hit.select(F.col("string").alias("chunk_id")), "chunk_id", "left_semi").select(key).distinct()


def targets(cells: DataFrame, existing: DataFrame, touched_: DataFrame, per_cell: int, built_before: bool, key: str = "cell_key", by: str = "competency_key") -> DataFrame:
    """``existing`` and ``target`` of each cell: a new cell gets ``per_cell``, a touched one as many more, others none."""
    hit = touched_.select(by).distinct().withColumn("__hit", F.lit(True))
    out = cells.join(existing.select(key, F.col("n").alias("existing")), key, "left").join(hit, by, "left").withColumn("existing", F.coalesce("existing", F.lit(0)).cast("long"))
    more = F.coalesce("__hit", F.lit(False)) & F.lit(built_before)
    target = F.when(F.col("existing") == 0, F.lit(per_cell)).when(more, F.col("existing") + per_cell).otherwise(F.col("existing"))
    return out.withColumn("target", target.cast("long")).drop("__hit")


def new_items(sized: DataFrame) -> DataFrame:
    """One row per item to create, numbered on from what exists."""
    grown = sized.where("target > existing")
    return grown.withColumn("item_index", F.explode(F.sequence("existing", F.col("target") - 1)))


def batches(items: DataFrame, size: int, cell: list[str], order: list[str]) -> DataFrame:
    """``batch, batch_pos``: a cell's items in as few calls as ``size`` allows, split evenly, larger calls first."""
    put = ranked(items, cell, order)
    batch, pos = evenly(F.col("__n"), F.col("__total"), F.ceil(F.col("__total") / size))
    return put.withColumn("batch", batch).withColumn("batch_pos", pos).drop("__n", "__total", "__sum")


def missing_verdicts(items: DataFrame, verdicts: DataFrame, judge: str, scope: str = "GENERAL") -> DataFrame:
    """Generated pool items without a verdict of the judge in the scope, wherever in the store they are."""
    done = verdicts.where((F.col("judge_model") == judge) & (F.col("scope") == scope)).select("item_id")
    return items.join(done, "item_id", "left_anti")


def candidates(items: DataFrame, verdicts: DataFrame, judge: str, cell: dict[str, str], as_of=None, scope: str = "GENERAL") -> DataFrame:
    """Accepted items of a cell under a judge, as they were at ``as_of``."""
    for c, value in cell.items():
        items = items.where(F.col(c) == value)
    if as_of is not None:
        items = items.where(F.col("updated_at") <= F.lit(as_of).cast("timestamp"))
    ok = verdicts.where((F.col("judge_model") == judge) & (F.col("scope") == scope) & F.col("accepted")).select("item_id")
    return items.join(ok, "item_id", "left_semi")


def judge_matrix(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with ``judges``: a map from judge to its decision, null without a verdict."""
    per = verdicts.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("judge_model", "accepted")))).alias("judges"))
    return items.join(per, "item_id", "left")


def enqueue_round_robin(topics: DataFrame, n: int) -> DataFrame:
    """Items 0..n-1 dealt to topics in turn; ``topics(position, topic)`` with positions from 0. Adds ``item_index``."""
    count = topics.agg(F.count(F.lit(1)).alias("t"))
    i = topics.sparkSession.range(n).crossJoin(F.broadcast(count))
    put = i.select(F.col("id").alias("i"), (F.col("id") % F.col("t")).alias("position"), F.expr("id div t").alias("item_index"))
    return put.join(topics, "position")


def ladder(index, levels: list[int]):
    """The level of an item: the levels in turn."""
    return F.element_at(F.array(*[F.lit(x) for x in levels]), (t.col(index) % len(levels) + 1).cast("int"))


def top_up(missing, cells):
    """Items to add to each cell for so many missing questions."""
    return F.greatest(F.lit(1), F.ceil(t.col(missing) / t.col(cells))).cast("long")
