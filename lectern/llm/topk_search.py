"""Exact top-k search by inner product: distributed histogram selection.

Every query is scored against every vector. The scores aren't kept: each pass counts, in its tasks and then over all of them,
how many fall into each of 512 equal bins of the interval that is known to hold a query's ``k``-th highest score, and goes on
with the bin that holds it, until a bin is one integer wide. A last pass emits what scores more, and of the equals those with
the smallest ids.

Queries go in blocks of about ``BLOCK``, which is what a task holds besides the vectors it reads; what the driver holds is a
few numbers for each query of a block. The work is the number of queries times that of vectors, as the task asks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, materialize

#: Queries that are looked for together; their vectors and intervals are what is sent to every task.
BLOCK = 4096
#: Bits of the score that one pass settles.
BITS = 9
#: Scores beyond this, which only components in the hundred millions give, count as this.
MOST = 1 << 61
_NEVER = np.iinfo(np.int64).min
_CELLS = 1 << 20


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, row, v, size``: each vector's components as ``floor(scale * x)`` in doubles, a row number, and the sum of the
    squares. Vectors that are null or hold a null or non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(2).is_valid())
            length = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            x = pc.floor(pc.multiply(b.column(2).flatten(), float(scale))).to_numpy(zero_copy_only=False)  # a null is a NaN
            end = np.cumsum(length)
            bad = np.r_[0, np.cumsum(~np.isfinite(x))]
            fine = bad[end] == bad[end - length]
            x, length = x[np.repeat(fine, length)], length[fine]
            with np.errstate(over="ignore"):
                total = np.bincount(np.repeat(np.arange(len(length)), length), weights=x * x, minlength=len(length))
            b = b.filter(pa.array(fine))
            v = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), v, pa.array(total, pa.float64())], ["id", "row", "v", "size"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(freeing(run), "id long, row long, v array<double>, size double")


@dataclass
class Block:
    """Queries of a block with what is known of them: the ``need``-th score of those in ``[low, low + 2 ** bits)`` is looked
    for; ``open`` says whether there are so many."""

    row: np.ndarray
    id: list
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]
    low: np.ndarray
    need: np.ndarray
    open: np.ndarray


def _matrix(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and components of a list column's rows, those of one length together."""
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, end = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(length)
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield int(d), at, flat[(end[at] - d)[:, None] + np.arange(d)] if len(at) < len(length) else flat.reshape(-1, d)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of integers, exact up to :data:`MOST`."""
    d = max(1, a.shape[1])
    with np.errstate(over="ignore"):
        x, y = (np.abs(m).max(axis=1, initial=1.0) for m in (a, b))
        top = d * x.max(initial=1.0) * y.max(initial=1.0)
        kind = np.float32 if top < 1 << 24 else np.float64
        if top < 1 << 53:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
        out = np.clip(np.nan_to_num(a @ b.T), -(2.0**52), 2.0**52).astype(np.int64)
        for i, j in np.argwhere(d * x[:, None] * y[None, :] >= 1 << 53):
            out[i, j] = max(-MOST, min(MOST, sum(int(p) * int(q) for p, q in zip(a[i], b[j]))))
    return out


def _scored(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, the queries of their length, and their scores. A query's own row scores less than any."""
    by_row = np.argsort(block.row)
    for b in batches:
        for d, at, v in _matrix(b.column(2)):
            if d not in block.vectors:
                continue
            q, m = block.vectors[d]
            step = max(1, _CELLS // len(q))
            for lo in range(0, len(at), step):
                rows = b.take(pa.array(at[lo : lo + step]))
                score = products(v[lo : lo + step], m)
                mine = rows.column(1).to_numpy()
                slot = by_row[np.minimum(np.searchsorted(block.row, mine, sorter=by_row), len(by_row) - 1)]
                own = np.flatnonzero(block.row[slot] == mine)
                score[own, np.searchsorted(q, slot[own])] = _NEVER
                yield rows, q, score


def histogram(vectors: DataFrame, block: Block, bits: int) -> DataFrame:
    """``query, bin, n, need``: scores of all vectors in the block's intervals of ``2 ** bits``, by bin. A task leaves out bins
    under the one that holds its own ``need``-th: the one looked for isn't there."""
    shift = max(0, bits - BITS)
    bins = 1 << min(bits, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((len(block.row), bins), np.int64)
        least = np.zeros(len(block.row), np.int64)

        def raise_floor() -> None:
            above = np.cumsum(tally[:, ::-1], axis=1)
            enough = above >= block.need[:, None]
            least[:] = np.maximum(least, np.where(enough.any(axis=1), bins - 1 - enough.argmax(axis=1), 0))

        for n, (_, q, score) in enumerate(_scored(batches, block), 1):
            low = block.low[q] + (least[q] << shift)
            r, c = np.nonzero((score >= low) & block.open[q])
            at = (score[r, c] - block.low[q[c]]) >> shift
            inside = at < bins
            tally += np.bincount(q[c[inside]] * bins + at[inside], minlength=tally.size).reshape(tally.shape)
            if n & (n - 1) == 0:
                raise_floor()
        raise_floor()
        r, c = np.nonzero(tally * (np.arange(bins) >= least[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (r, c, tally[r, c], block.need[r])], ["query", "bin", "n", "need"])

    found = vectors.mapInArrow(freeing(run), "query long, bin long, n long, need long")
    return found.groupBy("query", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))


def locate(vectors: DataFrame, block: Block, bits: int) -> Block:
    """Narrow the block's intervals to one integer."""
    while bits > 0 and block.open.any():
        w = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        reached = histogram(vectors, block, bits).withColumn("above", F.sum("n").over(w) - F.col("n"))
        found = reached.where("above < need and above + n >= need").select("query", "bin", "above").toPandas()  # one a query
        bits = max(0, bits - BITS)
        at = found["query"].to_numpy(np.int64)
        low, need, there = block.low.copy(), block.need.copy(), np.zeros(len(block.row), bool)
        low[at] += found["bin"].to_numpy(np.int64) << bits
        need[at] -= found["above"].to_numpy(np.int64)
        there[at] = True
        # a query with fewer vectors than it asks for takes them all
        low[block.open & ~there] = -MOST
        block = Block(block.row, block.id, block.vectors, low, need, block.open & there)
    return block


def emit(vectors: DataFrame, block: Block, k: int) -> DataFrame:
    """The ``k`` best of each query: what scores at least its ``k``-th, each task's best ``k`` of it, then the best of all."""
    schema = "query_id long, query_row long, vec_id long, row long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def best() -> np.ndarray:
            a = np.concatenate([np.zeros((0, 5), np.int64), *held])  # query, score, id is null, id, row
            a = a[np.lexsort((a[:, 4], a[:, 3], a[:, 2], -a[:, 1], a[:, 0]))]
            place = np.arange(len(a)) - np.searchsorted(a[:, 0], a[:, 0])
            return a[place < k]

        for rows, q, score in _scored(batches, block):
            r, c = np.nonzero(score >= block.low[q])
            null = rows.column(0).is_null().to_numpy(zero_copy_only=False)[r].astype(np.int64)
            ids = rows.column(0).fill_null(0).to_numpy()[r]
            held.append(np.stack([q[c], score[r, c], null, ids, rows.column(1).to_numpy()[r]], axis=1))
            if sum(map(len, held)) > _CELLS:
                held[:] = [best()]
        a = best()
        ids = pa.array(a[:, 3], mask=a[:, 2] == 1)
        query = pa.array(block.id, pa.int64()).take(pa.array(a[:, 0]))
        yield pa.RecordBatch.from_arrays([query, pa.array(block.row[a[:, 0]]), ids, pa.array(a[:, 4]), pa.array(a[:, 1])], ["query_id", "query_row", "vec_id", "row", "score"])

    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = vectors.mapInArrow(freeing(run), schema).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(rows: pa.Table, k: int, bits: int) -> Block:
    rows = rows.combine_chunks()
    n = rows.num_rows
    vectors = {d: (at, np.ascontiguousarray(v)) for d, at, v in _matrix(rows["v"].chunk(0))} if n else {}
    return Block(rows["row"].to_numpy(), rows["id"].to_pylist(), vectors, np.full(n, -(1 << (bits - 1)), np.int64), np.full(n, k, np.int64), np.ones(n, bool))


def search(vectors: DataFrame, queries: str = "id % 50 = 0", k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` that fulfils ``queries`` (SQL over ``id``), the ``k`` other
    rows with the highest inner product of components ``floor(scale * x)``; of equal scores the smaller id, null last, then
    an earlier row. All, if there are fewer.

    Vectors null, or holding null or non-finite components, are neither queries nor found. Vectors of different lengths have
    no product and don't meet; two empty ones score 0. Rows are told apart by themselves: a repeated id or vector is found
    like any other, and a repeated query is answered as often as it occurs; a row without an id is no query.
    Scores beyond 2**61 count as 2**61. An empty table gives no row.
    """
    spark = vectors.sparkSession
    made = materialize(integers(vectors, id_col, vec_col, scale))
    asked = made.where(queries)
    n, top = asked.count(), made.agg(F.max("size")).first()[0]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # no product is beyond the largest sum of squares
    bits = int(min(float(MOST), top * (1 + 1e-9))).bit_length() + 1
    blocks = -(-n // BLOCK)
    part = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = None
    for i in range(blocks):
        block = locate(made, _block(asked.where(part == i).select("id", "row", "v").toArrow(), k, bits), bits)
        if len(block.row):
            best = emit(made, block, k)
            found = best if found is None else found.union(best)
    return found
