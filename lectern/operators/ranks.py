"""Places and running sums inside groups of any size.

A window gives a whole group to one task. Here the rows are dealt out by ranges of group and order, so that a large group
goes over many tasks; each task counts and sums what it has as the rows stream by, and what the tasks before it had of the same
group, one number a task, is added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Up to so many parts of groups are sent to every task, about fifty bytes and the group's name each.
SENT = 100_000


def ranked(rows: DataFrame, group: list[str], order: list[str | Column], value: str | None = None) -> DataFrame:
    """``rows`` with ``__n``, the place in the group from 1 on, ``__total``, the group's rows, and ``__sum``, the running sum of
    the whole numbers ``value`` up to and with the row (0 without; a null adds nothing). ``order`` must leave no ties.

    Nulls in ``group`` are a group like any other. An empty table gives no row.
    """
    name = F.to_json(F.struct(*group)) if group else F.lit("")
    put = rows.withColumn("__g", name).withColumn("__v", F.coalesce(F.col(value).cast("long"), F.lit(0)) if value else F.lit(0).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in put.schema)
    at = len(put.columns) - 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, s = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, v = b.column(at), b.column(at + 1).to_numpy()
            new = np.r_[g[0].as_py() != last, pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            place, sums, start = np.arange(1, len(v) + 1), np.cumsum(v), np.flatnonzero(new)
            # what came before a group's first row here doesn't count; of the batch's first group the task's earlier rows do
            first = np.searchsorted(start, place - 1, side="right") - 1
            own = start[np.maximum(first, 0)] if len(start) else np.zeros(len(v), np.int64)
            base = np.where(first >= 0, own, -n)
            before = np.where(first >= 0, (sums - v)[own], -s)
            places, running = place - base, sums - before
            last, n, s = g[-1].as_py(), int(places[-1]), int(running[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places), pa.array(running), pa.array(np.full(len(v), part, np.int32))], [*b.schema.names, "__n", "__s", "__part"])

    dealt = put.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order) if group or order else put
    counted = written(dealt.mapInArrow(count, f"{kinds}, __n long, __s long, __part int"))
    parts = counted.groupBy("__g", "__part").agg(F.max("__n").alias("n"), F.max_by("__s", "__n").alias("s"))
    w = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)  # of a group's parts
    before = parts.select(
        "__g", "__part", (F.sum("n").over(w) - F.col("n")).alias("__n0"), (F.sum("s").over(w) - F.col("s")).alias("__s0"), F.sum("n").over(Window.partitionBy("__g")).alias("__total")
    )
    before = written(before)
    small = before.limit(SENT + 1).count() <= SENT
    both = counted.join(F.broadcast(before) if small else before, ["__g", "__part"])
    return both.select(*rows.columns, (F.col("__n") + F.col("__n0")).alias("__n"), "__total", (F.col("__s") + F.col("__s0")).alias("__sum"))


def evenly(place: Column, total: Column, parts: Column) -> tuple[Column, Column]:
    """Number (from 0) and place (from 0) of a row in one of ``parts`` contiguous parts of near-equal size, the larger first."""
    base, extra = F.floor(total / parts), total % parts
    head, i = extra * (base + 1), place - 1
    of = F.when(i < head, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - head) / F.greatest(base, F.lit(1))))
    at = F.when(i < head, i % (base + 1)).otherwise((i - head) % F.greatest(base, F.lit(1)))
    return of.cast("long"), at.cast("long")
