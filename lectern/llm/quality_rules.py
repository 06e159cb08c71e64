"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each document gets a few measures. A labelled holdout tells, per stratum, how often a cutoff on a measure would reject a
document that its label calls good. Of the cutoffs whose false rejection is under the allowed risk with the required
confidence - by the exact binomial tail, the error split over all cutoffs, measures and strata tried - the one that rejects
most is selected. The risk is split over the measures, so that all together stay under it. A stratum whose holdout is too
small to prove anything keeps everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

SYMBOLS = r"[#*$%&|<>]"
#: Cutoffs tried for each measure; a document above one would go.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "repeat_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "word_length": (6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0),
}
RISK, ERROR = 0.02, 0.05


def _repeat_words(words: str) -> Column:
    """Words inside a three-word window that occurs twice or more.

    Windows are sorted by hash with their place, those with an equal neighbour are kept, and the union of the words
    they cover is added up along their places.
    """
    n = F.size(words)
    w = lambda i: F.get(words, i)
    marks = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w(i), w(i + 1), w(i + 2)).alias("h"), i.alias("p"))))
    return F.when(n >= 3, marks).otherwise(F.expr("cast(array() as array<struct<h: bigint, p: int>>)"))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` (longs). Null text has no word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn("__marks", _repeat_words("__words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    hit = F.filter("__marks", lambda x, i: (F.get("__marks", i - 1)["h"] == x["h"]) | (F.get("__marks", i + 1)["h"] == x["h"]))
    out = out.withColumn("__lines", lines).withColumn("__places", F.array_sort(F.transform(hit, lambda x: x["p"])))
    # each place covers its three words, less what the place before it covers already
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("__places", zero, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last")))["n"]
    out = out.withColumn("n_words", F.size("__words").cast("long")).withColumn("word_chars", F.length(F.concat_ws("", "__words")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    out = out.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    return out.withColumn("n_repeat_words", covered).drop("__words", "__marks", "__lines", "__places")


def shares(df: DataFrame) -> DataFrame:
    """The measures that cutoffs are set on, from the counts."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns({"symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms so that no n underflows."""
    step = F.lit(p / (1 - p))
    start = F.struct((n * F.lit(math.log1p(-p))).alias("term"), (n * F.lit(math.log1p(-p))).alias("total"))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i * step)
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    whole = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, add)["total"]
    return F.least(F.lit(1.0), F.exp(whole))


def thresholds(labelled: DataFrame, strata: DataFrame, grids: dict[str, tuple[float, ...]] | None = None, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum, measure, cutoff``: the selected cutoffs.

    ``labelled(stratum, good, <measures>)`` is the holdout; ``strata(stratum)`` names the strata, over which the allowed
    ``error`` is split along with measures and cutoffs (Bonferroni). A cutoff is admitted if, were its false rejection its
    measure's share of ``risk`` or more, so few rejected good documents would have a chance below its share of the error.
    """
    grids = grids or GRIDS
    risk /= len(grids)
    tried = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(c).alias("cutoff"), F.col(m).alias("value")) for m, cs in grids.items() for c in cs]))
    each = labelled.where("good").select("stratum", tried.alias("t")).select("stratum", "t.*")
    counts = each.groupBy("stratum", "measure", "cutoff").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > F.col("cutoff")).cast("long")).alias("k"))
    tests = strata.select(F.count_distinct("stratum").alias("__s")).select((F.col("__s") * sum(map(len, grids.values()))).alias("tests"))
    # a cutoff that rejects the share at risk or more can't pass; its tail isn't summed
    k = F.when(F.col("k") < F.col("n") * risk, F.col("k"))
    proved = counts.crossJoin(F.broadcast(tests)).where(k.isNotNull()).where(binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(error) / F.col("tests"))
    return proved.groupBy("stratum", "measure").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", *, grids: dict[str, tuple[float, ...]] | None = None, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons`` of every row.

    ``labels(id, good)``: ids with any null are passed over; an id labelled twice is good only if every label says so. A
    null stratum is a stratum of its own. Rows that repeat an id are judged one by one (and count as often in the holdout).
    Without labels no cutoff is proved and only the base rules decide. An empty table gives no row.
    """
    grids = grids or GRIDS
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00")).alias("stratum"))
    told = materialize(shares(measures(slim, "text")).drop("text").withColumn("base_failed", base_failed()))
    truth = labels.select(F.col("id").cast("long").alias("id"), F.col("good").alias("good")).dropna().groupBy("id").agg(F.min("good").alias("good"))
    # the cutoffs decide only over what the base rules leave, and are proved on the same
    holdout = told.where(~F.col("base_failed")).join(truth, "id")
    chosen = thresholds(holdout, told.select("stratum").distinct(), grids, risk, error)
    wide = chosen.groupBy("stratum").agg(*[F.min(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"__{m}") for m in grids])
    out = told.join(wide, "stratum", "left")
    over = {m: F.coalesce(F.col(m) > F.col(f"__{m}"), F.lit(False)) for m in grids}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in over.items()]))
    out = out.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")
