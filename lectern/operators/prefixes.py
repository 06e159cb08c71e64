"""Which strings begin with one of a set of names: a sweep over both in order.

In the order of bytes a name is followed by all strings that begin with it. A task sweeps a range of that order with a stack of
the names that the current string begins with. A name from an earlier range matters there only if the range's lower end begins
with it, so each range gets those few in advance, and every string and every name goes to one task once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Strings that the ranges are drawn from: this many come to the driver.
SAMPLE = 10_000


def beginnings(strings: DataFrame, names: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``string, names`` of each distinct string of ``strings(string)`` that begins with any of ``names(name)``: these, from the
    shortest on. A string begins with itself, and with the empty name; nulls match nothing."""
    spark = strings.sparkSession
    s = strings.where("string is not null").select(F.col("string").cast("binary").alias("s")).distinct()
    d = names.where("name is not null").select(F.col("name").cast("binary").alias("s")).distinct()
    every = written(d.select("s", F.lit(0).alias("kind")).union(s.select("s", F.lit(1).alias("kind"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted({bytes(r.s) for r in every.select("s").orderBy(F.xxhash64("s")).limit(sample).collect()})  # a bounded sample
    ends = [drawn[i * len(drawn) // n] for i in range(1, n)] if drawn else []
    ends = sorted(set(ends))
    # of each range's lower end the shorter beginnings that are names
    lower = spark.createDataFrame([(i + 1, bytearray(e)) for i, e in enumerate(ends) if e], "part int, e binary")
    cut = lower.select("part", F.explode(F.sequence(F.lit(0), F.length("e") - 1)).alias("n"), "e").select("part", F.expr("substring(e, 1, n)").alias("s"))
    open_ = cut.join(every.where("kind = 0"), "s", "left_semi").select("part", "s", F.lit(0).alias("kind"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [bisect_right(ends, x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], ["part", "s", "kind"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for b in batches:
            found, of = [], []
            for part, x, kind in zip(*(c.to_pylist() for c in b.columns)):
                if part != at:
                    at, stack = part, []
                while stack and not x.startswith(stack[-1]):
                    stack.pop()
                if kind == 0:
                    stack.append(x)
                elif stack:
                    found.append(x)
                    of.append(list(stack))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(of, pa.list_(pa.binary()))], ["s", "names"])

    placed = every.mapInArrow(place, "part int, s binary, kind int").union(open_)
    ordered = placed.repartition(n, "part").sortWithinPartitions("part", "s", "kind")
    out = ordered.mapInArrow(sweep, "s binary, names array<binary>")
    return out.select(F.col("s").cast("string").alias("string"), F.col("names").cast("array<string>").alias("names"))
