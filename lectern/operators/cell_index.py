"""Exact top-k by cosine over an index of cells.

Vectors are put into cells around centres that a bounded sample gives; a cell keeps its size and its widest angle from the
centre. By the triangle inequality no vector of a cell is nearer to a query than the angle to the centre less that width. A
query is scored against its best cells until they hold ``k`` vectors; after that only against cells that could still hold a
better one than its ``k``-th. So nothing is missed, however the centres lie: they decide the work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .retrieval import _best, matrix, with_norm

#: Bounds: vectors that the centres are made from, centres, and rows of a cell (or queries of one) that a task holds.
SAMPLE, CELLS, SLICE = 20_000, 2048, 4096
#: What rounding may take from a bound.
SLACK = 1e-7
#: Vectors without a direction, or of another length than the centres, are in a cell of their own that is always scored.
ODD = -1


@dataclass
class CellIndex:
    """``rows`` has the index with ``__cell`` and ``__slice``; the arrays are by cell."""

    rows: DataFrame
    vector: str
    centres: np.ndarray
    width: np.ndarray
    size: dict[int, int]

    def slices(self, cell: int) -> int:
        return -(-self.size.get(cell, 0) // SLICE)

    @property
    def total(self) -> int:
        return sum(self.size.values())


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have the length and a direction, and their unit vectors."""
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    x = matrix(column)
    x = x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    norm = np.sqrt((x * x).sum(axis=1))
    fine = (length == dim) & np.isfinite(norm) & (norm > 0)
    return fine, x[fine] / norm[fine, None]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def centres_of(units: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Unit vectors in the middle of groups of ``units``: some rounds of spherical k-means from evenly spaced starts."""
    c = units[np.linspace(0, len(units) - 1, min(cells, len(units))).astype(int)] if len(units) else units
    for _ in range(rounds if len(c) > 1 else 0):
        of = np.concatenate([(units[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(units), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, units)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def build(index: DataFrame, vector: str = "embedding", cells: int | None = None) -> CellIndex:
    """Put an index into cells, about as many as the root of its rows unless told. Rows with a null vector are left out."""
    index = index if "norm" in index.columns else with_norm(index, vector)
    index = index.where(F.col(vector).isNotNull())
    n = index.count()
    drawn = index.select(vector).orderBy(F.xxhash64(vector)).limit(SAMPLE).toArrow()[vector].combine_chunks()  # a bounded sample
    lengths = pc.list_value_length(drawn).to_numpy(zero_copy_only=False)
    dim = int(np.bincount(lengths.astype(int)).argmax()) if len(lengths) else 1
    centres = centres_of(_unit(drawn, dim)[1] if len(lengths) else np.zeros((0, 1)), cells or min(CELLS, max(1, int(n**0.5))))
    shared = index.sparkSession.sparkContext.broadcast(centres)  # CELLS vectors at most
    at = index.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            fine, units = _unit(b.column(at), dim)
            cell, angle = np.full(b.num_rows, ODD), np.zeros(b.num_rows)
            if len(c) and len(units):
                cosine = units @ c.T
                cell[fine] = cosine.argmax(axis=1)
                angle[fine] = _angle(cosine.max(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*b.schema.names, "__cell", "__angle"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    put = index.mapInArrow(run, f"{kinds}, __cell int, __angle double")
    rows = written(put.withColumn("__row", F.monotonically_increasing_id()))
    of = rows.groupBy("__cell").agg(F.max("__angle").alias("a"), F.count(F.lit(1)).alias("n")).collect()  # a row a cell
    width = np.zeros(len(centres))
    for r in of:
        if r["__cell"] != ODD:
            width[r["__cell"]] = r["a"]
    made = CellIndex(rows, vector, centres, width, {r["__cell"]: r["n"] for r in of})
    parts = _lookup(made, {c: made.slices(c) for c in made.size})
    made.rows = rows.withColumn("__slice", F.pmod(F.xxhash64("__row"), parts).cast("int")).drop("__angle", "__row")
    return made


def _lookup(ix: CellIndex, values: dict[int, int]):
    """A number by cell, as a column; at most ``CELLS`` numbers."""
    listed = [max(1, values.get(c, 1)) for c in range(ODD, len(ix.centres))]
    return F.get(F.array(*[F.lit(x) for x in listed]), F.col("__cell") + 1)


def _bounds(ix: CellIndex, b: pa.RecordBatch) -> np.ndarray:
    """The highest cosine that each query may have with a vector of each cell."""
    out = np.ones((b.num_rows, len(ix.centres)))
    if len(ix.centres):
        fine, units = _unit(b.column(1), ix.centres.shape[1])
        out[fine] = np.cos(np.maximum(0.0, _angle(units @ ix.centres.T) - ix.width[None, :])) + SLACK
    return out


def _first_cells(bound: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Which cells each query looks at first: its best until they hold ``k`` vectors."""
    by = np.argsort(-bound, axis=1, kind="stable")
    held = np.cumsum(size[by], axis=1)
    first = np.zeros(bound.shape, bool)
    np.put_along_axis(first, by, held - size[by] < k, axis=1)
    return first & (size > 0)


def _pairs(ix: CellIndex, queries: DataFrame, k: int, later: bool) -> DataFrame:
    """``query_id, query_vector, n, __cell``: the cells each query looks at first, or those that may still better its ``least``."""
    size = np.array([ix.size.get(c, 0) for c in range(len(ix.centres))], np.int64)
    slim = CellIndex(None, ix.vector, ix.centres, ix.width, ix.size)
    shared = queries.sparkSession.sparkContext.broadcast(slim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bound = _bounds(shared.value, b)
            first = _first_cells(bound, size, k)
            goes = first if not later else ~first & (size > 0) & (bound >= b.column(3).to_numpy()[:, None])
            odd = np.full((b.num_rows, 1), not later and shared.value.size.get(ODD, 0) > 0)
            i, cell = np.nonzero(np.hstack([odd, goes]))
            some = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array((cell - 1).astype(np.int32))], ["query_id", "query_vector", "n", "__cell"])

    kind = queries.schema["query_vector"].dataType.simpleString()
    return queries.mapInArrow(run, f"query_id long, query_vector {kind}, n double, __cell int")


def _scores(ix: CellIndex, pairs: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The best ``k`` of each query in each cell it is paired with, and how many vectors were scored. A hot cell is dealt out by
    slices, and the queries of one that many look at by blocks: a task holds ``SLICE`` of either, more or less."""
    pairs = written(pairs)
    asked = {r["__cell"]: r["n"] for r in pairs.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    blocks = _lookup(ix, {c: -(-n // SLICE) for c, n in asked.items()})
    slices = _lookup(ix, {c: ix.slices(c) for c in ix.size})
    q = pairs.withColumn("__block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    wanted = ix.rows.where(F.col("__cell").isin(*asked) if asked else F.lit(False))
    x = wanted.withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    kept = [c for c in ix.rows.columns if c not in (ix.vector, "norm", "__cell", "__slice")]
    kinds = {f.name: f.dataType.simpleString() for f in ix.rows.schema}
    vector = ix.vector

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, an, y, yn = matrix(left["query_vector"]), left["n"].to_numpy(), matrix(right[vector]), right["norm"].to_numpy()
            for lo in range(0, len(a), 256):
                i, j = _best(a[lo : lo + 256], an[lo : lo + 256], y, yn, k)
                i += lo
                wide = min(a.shape[1], y.shape[1])
                dot, norms = np.cumsum(a[i, :wide] * y[j, :wide], axis=1)[:, -1], an[i] * yn[j]
                s = np.divide(dot, norms, out=np.zeros(len(i)), where=norms != 0)
                some = right.select(kept).take(pa.array(j))
                out.append(pa.table([left["query_id"].take(pa.array(i)), *some.columns, pa.array(s)], names=["query_id", *kept, "score"]))
        none = pa.table([pa.array([], pa.int64()), *right.select(kept).slice(0, 0).columns, pa.array([], pa.float64())], names=["query_id", *kept, "score"])
        return pa.concat_tables(out) if out else none

    by = ["__cell", "__slice", "__block"]
    schema = ", ".join(["query_id long", *(f"`{c}` {kinds[c]}" for c in kept), "score double"])
    scored = q.groupBy(*by).cogroup(x.select(*by, *kept, vector, "norm").groupBy(*by)).applyInArrow(score, schema)
    return scored, sum(n * ix.size[c] for c, n in asked.items())


def top_k(queries: DataFrame, ix: CellIndex, k: int, order: str = "chunk_ord") -> tuple[DataFrame, float]:
    """``query_id, <index columns>, score, rank``, as :func:`retrieval.top_k` gives it, and the share of all pairs of a query and a
    vector that were scored for it. ``queries(query_id, query_vector)`` may be as many as the index; null vectors are left out."""
    from ..functions import vectors as v

    asked = written(queries.where("query_vector is not null").select("query_id", "query_vector", v.norm("query_vector").alias("n")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), order)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    near, n1 = _scores(ix, _pairs(ix, asked, k, False), k)
    near = written(ranked(near).drop("rank"))
    least = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
    with_least = asked.join(least, "query_id", "left").select("query_id", "query_vector", "n", F.coalesce("least", F.lit(-2.0)).alias("least"))
    far, n2 = _scores(ix, _pairs(ix, with_least, k, True), k)
    pairs = asked.count() * ix.total
    return ranked(near.unionByName(far)), (n1 + n2) / pairs if pairs else 0.0
