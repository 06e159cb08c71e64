"""Plain Lloyd clustering in whole numbers.

Centroids, at most a few, go to every task. A pass takes the squared difference of each vector from each centroid in NumPy,
assigns it to the nearest (the first of equals), and sums up each cluster's components inside the task; the tasks' sums, one
row a cluster, are added up by cluster. Sums of whole numbers don't depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A component beyond this (an ``x`` beyond 131,072 at a scale of 1,024) counts as this: squared distances stay whole numbers of 64 bits.
MOST = 1 << 27
_CELLS = 1 << 22


def whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int, size: int) -> DataFrame:
    """``id, v``: vectors of exactly ``size`` finite components, each as ``floor(scale * x)`` in 32 bits, packed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["v"].to_list(), np.float64).reshape(-1, size)
            f = f[np.isfinite(x).all(axis=1)]
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(x[np.isfinite(x).all(axis=1)] * scale), -MOST, MOST).astype("<i4")
            yield pd.DataFrame({"id": f["id"], "v": [r.tobytes() for r in x]})

    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) == size) & ~F.coalesce(F.array_contains(F.transform(v, F.isnull), True), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(fine)
    return rows.mapInPandas(run, "id long, v binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; of equals the smallest number."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _pieces(f: pd.DataFrame, size: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    step = max(1, _CELLS // max(1, size))
    for lo in range(0, len(f), step):
        piece = f.iloc[lo : lo + step]
        yield piece, np.frombuffer(b"".join(piece["v"]), "<i4").reshape(-1, size).astype(np.int64)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, total``: of each cluster the number of its vectors and the sums of their components. A task gives one
    row a cluster."""
    k, size = centroids.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for f in frames:
            for _, x in _pieces(f, size):
                at, _ = nearest(x, centroids)
                n += np.bincount(at, minlength=k)
                np.add.at(total, at, x)
        on = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": on, "n": n[on], "total": pd.Series(list(total[on]), dtype=object)})

    parts = vectors.select("v").mapInPandas(run, "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i].cast("decimal(19,0)")).alias(f"c{i}") for i in range(size)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).select("cluster", "n", F.array(*[f"c{i}" for i in range(size)]).alias("total"))


def step(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: ``floor(sum / count)`` of each cluster, an empty one's as it was."""
    after = centroids.copy()
    for r in cluster_sums(vectors, centroids).collect():  # one row a centroid at most
        after[r.cluster] = [int(t) // r.n for t in r.total]
    return after


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    size = centroids.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for piece, x in _pieces(f, size):
                at, d = nearest(x, centroids)
                yield pd.DataFrame({"id": piece["id"], "cluster": at, "distance": d})

    return vectors.mapInPandas(run, "id long, cluster int, distance long")


def by_hash(seed: int) -> Callable[[Column], Column]:
    """Order of first centroids: the hexadecimal SHA-256 of ``seed:id``."""
    return lambda i: F.sha2(F.concat(F.lit(f"{seed}:"), i.cast("string")).cast("binary"), 256)


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    size: int = 64,
    order: Callable[[Column], Column] = by_hash(3),
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` of every vector after ``rounds`` of Lloyd's algorithm and one more assignment, and the final
    centroids.

    Vectors that are null, have not ``size`` components or hold a null or non-finite one aren't kept; components are
    ``floor(scale * x)``. The first centroids are the ``k`` kept vectors first by ``order`` of their id (no id comes last; of
    equal ids, the smaller vector, component by component), or all, if there are fewer. Some centroids may be equal: the
    smaller number has their vectors. Repeated rows count each. An empty table gives no row and no centroid.
    """
    made = materialize(whole(vectors, id_col, vec_col, scale, size))
    first = made.select("v", order(F.col("id")).alias("h")).orderBy(F.asc_nulls_last("h"), _sortable("v")).limit(k).collect()
    centroids = np.array([np.frombuffer(r.v, "<i4") for r in first], np.int64).reshape(-1, size)
    if not len(centroids):
        return made.selectExpr("id", "0 as cluster", "0L as distance"), centroids
    for _ in range(rounds):
        centroids = step(made, centroids)
    return assign(made, centroids), centroids


def _sortable(v: str) -> Column:
    """Packed components as bytes whose order is that of the vectors: made unsigned, the high byte first."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda b: (np.frombuffer(b, "<i4").astype(np.int64) + (1 << 31)).astype(">u4").tobytes())

    return f(F.col(v))


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of a centroid's components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` with ``cluster_inertia`` and ``inertia``, the sums of distances over the cluster and over all
    (2**63 - 1 at most), and ``centroid_sha256``. What is joined has one row a centroid."""
    spark = found.sparkSession
    found = materialize(found)
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = [(r.cluster, r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()]
    whole_sum = sum(s for _, s in sums)
    rows = [(c, s, whole_sum, digest(centroids[c])) for c, s in sums]
    table = spark.createDataFrame(rows, "cluster int, s decimal(38,0), t decimal(38,0), centroid_sha256 string")
    capped = [F.least(c, top).cast("long").alias(n) for c, n in (("s", "cluster_inertia"), ("t", "inertia"))]
    return found.join(F.broadcast(table.select("cluster", *capped, "centroid_sha256")), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
