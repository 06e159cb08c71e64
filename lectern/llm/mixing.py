"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document is expected ``target / source_size`` times. The documents stand in one order, the expected
copies are summed along it, one random offset is added, and a document is emitted once for each integer boundary that its
stretch of the sum crosses. Documents of similar size are neighbours in that order, so the words taken stay near the target.

The prefix sum has two levels: counts of small groups (source, size class, range of the id's hash) are summed first, and a
window ranks the documents inside each group. A class has as many ranges as its count asks for, which changes no row's place;
so no task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: A size class is counted in ``FINE`` ranges of the hash (a power of two), which are joined to ones of about ``ROWS`` rows; a
#: source has at most some hundreds of classes.
FINE, ROWS = 4096, 50_000


def word_count(text: str) -> Column:
    """Words of a text column, null as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes for each doubling, in the order of the size; whole numbers only."""
    n = F.length(F.bin(size + 1)).cast("long")
    step = F.call_function("div", (size + 1) * 8, F.call_function("shiftleft", F.lit(1).cast("long"), (n - 1).cast("int")))
    return F.coalesce(n * 8 + step - 8, F.lit(0))  # never null: a join on it needs no filter in front of the scan


def _unit(key: Column) -> Column:
    """A number in [0, 1) from a string."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """``s_null, s_val, source_size, target`` of each source in ``sizes(s_null, s_val, source_size)``.

    A target is the smaller of ``cap`` times the source's size and its weight times one common level; the level is where
    the targets sum to ``share`` of all sizes. Sources are few: one window over them.
    """
    order = Window.orderBy("s_null", "s_val")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("long")
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    by = Window.orderBy("ratio", "s_null", "s_val")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # the level if every source before this one is full
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s_null", "s_val", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")))
    return s.select("s_null", "s_val", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, size_col: str | None = None,
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix", fine: int = FINE, rows: int = ROWS,
) -> DataFrame:
    """``docs`` with ``__size, __source_size, __target, __copies`` for every row.

    Size is the number of words (null text: 0), or what stands in ``size_col``. Sources in code point order, null last, take
    the ``weights`` in turn. No document is taken more than ``cap`` times, rounded up. Documents of a size class stand in the
    order of their ids' hashes, those of equal hash in the order of their ids, null first; rows that repeat an id share their
    copies in any order. Sources without a word have target 0 and no copies. An empty table gives no row; extra columns pass
    through. ``fine`` and ``rows`` deal the work out and change no result.
    """
    size = word_count(text_col) if size_col is None else F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    put = docs.withColumn("__size", size).withColumn("__s_null", F.col(source_col).isNull())
    put = put.withColumn("__s_val", F.coalesce(F.col(source_col), F.lit(""))).withColumn("__key", F.coalesce(key, F.lit("")))
    put = put.withColumn("__class", size_class(F.col("__size")))
    place = F.conv(F.substring("__key", 1, 6), 16, 10).cast("long")  # of 2 to the 24
    put = put.withColumn("__fine", F.call_function("div", place * fine, F.lit(1 << 24)))
    group = ["__s_null", "__s_val", "__class"]
    counted = materialize(put.groupBy(*group, "__fine").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words")))
    sizes = counted.groupBy(F.col("__s_null").alias("s_null"), F.col("__s_val").alias("s_val"))
    targets = source_targets(sizes.agg(F.sum("__words").alias("source_size")), weights, share, cap)
    # a class of n rows has the least power of two of ranges, up to all, by which a range has so many rows
    levels = fine.bit_length() - 1
    parts = [F.col("__all") > rows << k for k in range(levels)]
    width = F.lit(fine) if not parts else fine / F.pow(F.lit(2), sum(p.cast("int") for p in parts))
    classes = counted.groupBy(group).agg(F.sum("__n").alias("__all")).withColumn("__width", width.cast("long"))
    ranges = counted.join(classes, group).withColumn("__range", F.call_function("div", F.col("__fine"), F.col("__width")))
    ranges = ranges.groupBy(*group, "__width", "__range").agg(F.sum("__n").alias("__n"))
    # of a source: its size classes and their ranges of so many rows
    ahead = Window.partitionBy("__s_null", "__s_val").orderBy("__class", "__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    prefix = ranges.groupBy(*group, "__width").agg(F.map_from_entries(F.collect_list(F.struct("__range", "__ahead"))).alias("__before"))
    joined = prefix.join(targets, (F.col("__s_null") == F.col("s_null")) & (F.col("__s_val") == F.col("s_val")))
    joined = joined.select(*group, "__width", "__before", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    each = put.join(materialize(joined), group).withColumn("__range", F.call_function("div", F.col("__fine"), F.col("__width")))
    within = Window.partitionBy(*group, "__range").orderBy("__key", F.col(id_col).asc_nulls_first())
    each = each.withColumn("__rank", F.element_at("__before", F.col("__range")) + F.row_number().over(within))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(seed), F.when(F.col("__s_null"), F.lit("n")).otherwise(F.lit("s")), F.col("__s_val")).cast("binary"))
    copies = F.floor(F.col("__rank") * rate + offset) - F.floor((F.col("__rank") - 1) * rate + offset)
    each = each.withColumn("__copies", copies.cast("long"))
    return each.drop(*group, "__key", "__fine", "__width", "__before", "__range", "__rank")


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, with its own columns."""
    mixed = mix(docs, **how)
    return mixed.where("__copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
