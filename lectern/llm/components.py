"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, too_many


class Forest:
    """Union-find over integers in which the smallest member is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def contract(edges: DataFrame, held: int = 500_000) -> DataFrame:
    """Replace each task's edges by stars that connect the same nodes; ``held`` edges are looked at together."""

    def run(batches):
        f, n = Forest(), 0

        def stars():
            rows = [(x, f.root(x)) for x in list(f.up)]
            rows = [r for r in rows if r[0] != r[1]]
            a = np.array(rows, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f.join(x, y)
            n += b.num_rows
            if n > held:
                yield stars()
                f, n = Forest(), 0
        yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with the smallest neighbour of ``u``, and the minima. These are written apart, so that the join has plain
    inputs and a hub's edges can be split over tasks."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u"), least


def components(edges: DataFrame, rounds: int = 60, one_task: int = 200_000) -> DataFrame:
    """``node, component`` (its smallest node) of every node that has an edge in ``edges(u, v)``, longs without nulls.

    Self-loops and repeated edges don't matter; an empty table gives no row. Each step is written in the shared folder.
    Up to ``one_task`` edges, counted first, one task contracts all at once; more take the alternating steps.
    """
    now = materialize(contract(edges.where("u <> v")).distinct())
    size = None
    if not too_many(now, one_task):
        now, rounds = materialize(contract(now.repartition(1), one_task)), 0
    for _ in range(rounds):
        before, both = now, now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, least = _least(both)
        large = large.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")
        large = materialize(large.distinct())
        small, other = _least(large)
        # edges run from the larger to the smaller node: keep (u, m), hang the other neighbours on m
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(hung.union(small.select("u", F.col("m").alias("v"))).distinct())
        discard(before, least, large, other)
        # the sum of the labels falls until every node hangs on its component's smallest
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(found) == size:
            break
        size = tuple(found)
    else:
        if rounds:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
