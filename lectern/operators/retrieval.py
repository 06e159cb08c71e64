"""Retrieval operators: ranking by cosine, interleaving, token budget, composition, partition.

Snippets are rows in an explicit order; every tie is broken by a column.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from .ranks import evenly, ranked

# Fixed values.
BEGIN, END = "--- BEGIN LECTURE MATERIAL ---", "--- END LECTURE MATERIAL ---"
#: Queries are sent to every task; more than this are ranked in several passes.
QUERIES_AT_ONCE = 5_000


def with_norm(index: DataFrame, vector: str = "embedding") -> DataFrame:
    """The index with its norms, to be kept with it."""
    return index.withColumn("norm", v.norm(vector))


def top_k(queries: DataFrame, index: DataFrame, k: int, vector: str = "embedding", order: str = "chunk_ord") -> DataFrame:
    """``query_id, <index columns>, score, rank``: the k best of the index for each query, ties in index order.

    ``queries(query_id, query_vector)`` must be few and are counted before they are sent to the tasks; more than
    ``QUERIES_AT_ONCE`` take several passes. Each batch of the index is scored against a block of queries by one matrix
    product, and only what may be among its k best goes on, with its score summed in index order.
    """
    total = queries.count()
    if total > QUERIES_AT_ONCE:
        parts = -(-total // QUERIES_AT_ONCE)
        mine = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        pieces = [top_k(queries.where(mine == i), index, k, vector, order) for i in range(parts)]
        return reduce(DataFrame.unionByName, pieces)
    index = index if "norm" in index.columns else with_norm(index, vector)
    rows = queries.select("query_id", "query_vector", v.norm("query_vector").alias("n")).collect()  # QUERIES_AT_ONCE at most
    rows = [r for r in rows if r["query_vector"] is not None]
    ids = pa.array([r["query_id"] for r in rows], pa.int64())
    shared = index.sparkSession.sparkContext.broadcast((ids, _matrix([r["query_vector"] for r in rows]), np.array([r["n"] for r in rows], float)))
    kept = [c for c in index.columns if c not in (vector, "norm")]
    kinds = {f.name: f.dataType.simpleString() for f in index.schema}

    def run(batches):
        ids, q, qn = shared.value
        for b in batches:
            b = b.filter(b.column(len(kept)).is_valid())
            if not b.num_rows or not len(q):
                continue
            x, xn = matrix(b.column(len(kept))), b.column(len(kept) + 1).to_numpy()
            for lo in range(0, len(q), 256):
                i, j = _best(q[lo : lo + 256], qn[lo : lo + 256], x, xn, k)
                i += lo
                width = min(q.shape[1], x.shape[1])
                dot, norms = np.cumsum(q[i, :width] * x[j, :width], axis=1)[:, -1], qn[i] * xn[j]
                score = np.divide(dot, norms, out=np.zeros(len(i)), where=norms != 0)
                some = b.take(pa.array(j))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), *some.columns[: len(kept)], pa.array(score)], ["query_id", *kept, "score"])

    put = index.select(*kept, vector, "norm")
    scored = put.mapInArrow(run, ", ".join(["query_id long", *(f"`{c}` {kinds[c]}" for c in kept), "score double"]))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), order)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of doubles, from their flat buffer; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(length), max(1, int(length.max(initial=1)))))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(np.arange(len(length)), length), at] = flat
    return out


def _matrix(vectors: list) -> np.ndarray:
    """Rows of doubles; shorter ones end in zeros, so that a product is over the shorter length of two."""
    out = np.zeros((len(vectors), max([1, *map(len, vectors)])))
    for row, x in zip(out, vectors):
        row[: len(x)] = x
    return out


def _best(q: np.ndarray, qn: np.ndarray, x: np.ndarray, xn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a row of ``x`` that may be among its k best: all within rounding of the k-th."""
    width = min(q.shape[1], x.shape[1])
    norms = qn[:, None] * xn[None, :]
    s = np.divide(q[:, :width] @ x[:, :width].T, norms, out=np.zeros(norms.shape), where=norms != 0)
    if len(x) > k:
        last = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
        return np.nonzero(s >= last[:, None] - 1e-9)
    return np.nonzero(np.ones(s.shape, bool))


def interleave(ranked: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Snippets of several lists ``(position, rank, chunk_id)`` taken in turn: by rank, then list; the first of a chunk stays.
    Adds ``place`` from 1 on."""
    group = group or []
    first = Window.partitionBy(*group, "chunk_id").orderBy("rank", "position")
    kept = ranked.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("rank", "position")).cast("long"))


def render_snippet(source, unit, pages, text) -> Column:
    head = F.concat(F.lit("Lecture: "), t.col(source), F.lit(", Unit: "), t.col(unit))
    return F.concat(head, F.when(t.is_blank(pages), "").otherwise(F.concat(F.lit(", "), t.col(pages))), F.lit("\n"), t.col(text))


def within_budget(snippets: DataFrame, most: int, group: list[str], order: str = "place", tokens: str = "tokens") -> DataFrame:
    """The leading snippets whose tokens sum to ``most`` or less; the first always stays. The sum only grows, so cutting by it
    is stopping at the first that overflows."""
    if most <= 0:
        raise ValueError(f"the budget must be positive, got {most}")
    put = ranked(snippets, group, [order], tokens).withColumnRenamed("__sum", "tokens_so_far")
    return put.where((F.col("tokens_so_far") <= most) | (F.col("__n") == 1)).drop("__n", "__total")


def composition(snippets: DataFrame, group: list[str]) -> DataFrame:
    """Snippets, solutions, unknown roles and the share of solutions among all snippets of each group."""
    n, s = F.count(F.lit(1)), F.sum((F.col("role") == "SOLUTION").cast("long"))
    return snippets.groupBy(*group).agg(n.alias("snippets"), F.coalesce(s, F.lit(0)).alias("solutions"), F.sum(F.col("role").isNull().cast("long")).alias("unknown_roles"), (F.coalesce(s, F.lit(0)) / n).alias("solution_fraction"))


def role_counts(snippets: DataFrame, group: list[str]) -> DataFrame:
    """``counts_by_role`` map of each group, roles that don't occur left out."""
    per = snippets.where(F.col("role").isNotNull()).groupBy(*group, "role").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return per.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("counts_by_role"))


def grounding(snippets: DataFrame, most: int, group: list[str], order: str = "place") -> DataFrame:
    """The rendered block of each group, cut to ``most`` tokens, with its tokens and number of snippets."""
    put = snippets.withColumn("__text", render_snippet("source", "unit", "page_range", "text"))
    put = put.withColumn("tokens", t.approx_tokens(t.utf16_length("__text")))
    kept = within_budget(put, most, group, order)
    body = F.concat_ws("\n\n", F.array_sort(F.collect_list(F.struct(F.col(order), F.col("__text").alias("x"))))["x"])
    out = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("snippets"), body.alias("body"))
    block = F.concat(F.lit(BEGIN + "\n"), t.strip("body"), F.lit("\n" + END))
    return out.withColumn("block", block).drop("body").withColumn("approx_tokens", t.approx_tokens(t.utf16_length("block")))


def subsections(snippets: DataFrame, n: int, group: list[str] | None = None) -> DataFrame:
    """Snippets in reading order cut into ``n`` contiguous parts of near-equal size, the larger ones first (``section`` from 1)."""
    if n < 1:
        raise ValueError(f"at least one part is needed, got {n}")
    put = ranked(snippets, group or [], [t.chunk_document("chunk_id"), t.chunk_first_page("chunk_id"), F.col("chunk_id")])
    return put.withColumn("section", evenly(F.col("__n"), F.col("__total"), F.lit(n))[0] + 1).drop("__n", "__total", "__sum")
