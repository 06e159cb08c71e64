"""Item quality: validation, verdicts, gating, selection, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..schemas import FAILURE_MODES, SCOPES
from .ranks import ranked

# Fixed values.
BANNED = (
    r"(?:all|none|both|any|either|neither) of (?:the |these |those )?(?:above|below|these|those|options|answers|preceding)",
    r"both [a-d] and [a-d]",
    r"a and b",
    r"all answers are correct",
)
DANGLING = (
    r"(?:the|this|that|das|die|der|dem|den) (?:following|above|given|shown|presented|folgende[0-9A-Za-z_]*|obige[0-9A-Za-z_]*|gegebene[0-9A-Za-z_]*|gezeigte[0-9A-Za-z_]*|dargestellte[0-9A-Za-z_]*) "
    r"(?:tableau|table|figure|diagram|graph|network|matrix|linear program|program|lp|code|tabelle|abbildung|graph[0-9A-Za-z_]*|netzwerk|matrix|programm)"
)
OPTIONS, TRUE_FALSE_OPTIONS = 4, 2
LENGTH_MARGIN, LENGTH_RATIO = 20, 1.15


def _word_edges(x: Column, words: Column) -> Column:
    """``words`` stand in ``x`` as a whole phrase, literally. A boundary is where exactly one neighbour is an ASCII word
    character, so an end of the phrase that is no such character needs one outside."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(words, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    edge = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    return F.regexp_like(x, F.concat(F.lit(edge), quoted, F.lit(edge)))


def contained_option(texts: Column) -> Column:
    """One option's normalised text stands as a whole phrase inside a longer one's."""
    n = F.transform(texts, t.normalise_option)
    return F.exists(n, lambda a: F.exists(n, lambda b: (t.utf16_length(a) < t.utf16_length(b)) & _word_edges(b, a)))


def defect_of(kind: Column, title: Column, question: Column, options: Column) -> Column:
    """The first rule that an item breaks, null if none. ``options``: array of ``text, correct``."""
    texts = F.transform(options, lambda o: o["text"])
    right = F.filter(options, lambda o: o["correct"])
    wrong = F.filter(options, lambda o: ~o["correct"])
    longest = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda o: t.utf16_length(t.strip(o["text"])))), F.lit(0))
    need = F.when(kind == "true-false", TRUE_FALSE_OPTIONS).otherwise(OPTIONS)
    r, w = longest(right), longest(wrong)
    bad_count = F.when(kind == "multiple-choice", ~F.size(right).between(1, 3)).otherwise(F.size(right) != 1)
    return (
        F.when(t.is_blank(title) | t.is_blank(question), "BLANK_TEXT")
        .when(question.rlike("(?i)" + t.whole_word(DANGLING)) & ~question.contains("\n"), "DANGLING_REFERENCE")
        .when(F.size(options) != need, "OPTION_COUNT")
        .when(F.exists(texts, t.is_blank), "BLANK_OPTION")
        .when(F.size(F.array_distinct(F.transform(texts, F.lower))) != need, "DUPLICATE_OPTIONS")
        .when(F.exists(texts, lambda x: x.rlike("(?i)" + t.whole_word("|".join(BANNED)))), "BANNED_CONSTRUCTION")
        .when(contained_option(texts), "CONTAINED_OPTION")
        .when(bad_count, "CORRECT_COUNT")
        .when((w > 0) & (r - w >= LENGTH_MARGIN) & (r / w > LENGTH_RATIO), "CONSPICUOUS_LENGTH")
    )


def quiz_defect_of(mapped: Column, kind: Column, allowed: Column, title: Column, question: Column, options: Column) -> Column:
    """As :func:`defect_of`, for a question of a quiz: it must be readable and of a type that was asked for."""
    return F.when(~mapped, "UNMAPPABLE").when(~F.array_contains(allowed, kind), "TYPE_NOT_REQUESTED").otherwise(defect_of(kind, title, question, options))


def defect_histogram(items: DataFrame, by: list[str]) -> DataFrame:
    return items.where(F.col("defect").isNotNull()).groupBy(*by, "defect").agg(F.count(F.lit(1)).alias("n"))


def length_stats(title, question, explanation, options) -> Column:
    n = lambda x: F.coalesce(t.utf16_length(x), F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(t.col(options), lambda o: n(o["text"]))), F.lit(0))
    return F.struct(n(title).alias("title"), n(question).alias("question_text"), n(explanation).alias("explanation"), longest.alias("longest_option"))


def normalise_verdicts(scores: DataFrame, scope: str, by: list[str], order: str = "ord") -> DataFrame:
    """``scores(<by>, <order>, mode, severity, triggered)`` as judged -> one row per mode of complete verdicts.

    Names are tidied, unknown modes and those out of scope dropped, severities clamped (null: 0), of repeats the last counts;
    a verdict that lacks a mode of the scope is dropped whole.
    """
    modes = SCOPES[scope]
    name = F.upper(F.translate(F.regexp_replace("mode", r"^[\x00-\x20]+|[\x00-\x20]+$", ""), " -", "__"))
    put = scores.withColumn("mode", name).where(F.col("mode").isin(*modes))
    put = put.withColumn("severity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("severity", F.lit(0.0))))).withColumn("triggered", F.coalesce("triggered", F.lit(False)))
    last = put.groupBy(*by, "mode").agg(F.max_by(F.struct("severity", "triggered"), order).alias("v")).select(*by, "mode", "v.*")
    whole = last.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(modes)).drop("n")
    return last.join(whole, by, "left_semi")


def gate_of(gating: tuple[str, ...] | None, scope: str) -> tuple[str, ...]:
    """The modes that decide: the gating modes within the scope, all of them if none are named; an error if none remain."""
    if not gating:
        return SCOPES[scope]
    found = tuple(m for m in SCOPES[scope] if m in gating)
    if not found:
        raise ValueError(f"none of {gating} is judged under {scope}, so nothing could ever reject")
    return found


def mean_severity(severity="severity") -> Column:
    """Mean that doesn't depend on the order of the rows: summed exactly to twelve digits. (A mean may lie on a threshold.)"""
    return F.sum(t.col(severity).cast("decimal(18,12)")).cast("double") / F.count(t.col(severity))


def decide(severities: DataFrame, threshold: float, gating: tuple[str, ...] | None = None, by: str = "item_id") -> DataFrame:
    """``aggregate_score, mean_severity, accepted`` of each item from ``(item, mode, severity)``: one minus the worst gating
    severity (none: 0) against the threshold; the mean is over all modes."""
    counted = F.col("mode").isin(*gating) if gating else F.lit(True)
    agg = severities.groupBy(by).agg(F.coalesce(F.max(F.when(counted, F.col("severity"))), F.lit(0.0)).alias("worst"), F.coalesce(mean_severity(), F.lit(1.0)).alias("mean_severity"))
    return agg.withColumn("aggregate_score", 1 - F.col("worst")).withColumn("accepted", F.col("aggregate_score") >= F.lit(threshold)).drop("worst")


def redecide(severities: DataFrame, stored: DataFrame, threshold: float, gating: tuple[str, ...] | None = None, by: str = "item_id") -> DataFrame:
    """Decisions whose acceptance or score changes against ``stored(<by>, accepted, aggregate_score)``."""
    new = decide(severities, threshold, gating, by)
    old = stored.select(by, F.col("accepted").alias("was_accepted"), F.col("aggregate_score").alias("was_score"))
    both = new.join(old, by)
    return both.withColumn("changed", (F.col("accepted") != F.col("was_accepted")) | (F.col("aggregate_score") != F.col("was_score")))


def clean_selection(chosen: DataFrame, known: DataFrame, cap: int, by: list[str]) -> DataFrame:
    """Chosen ids that are known, the first of each, in the order chosen, at most ``cap``. ``chosen(<by>, pos, id)``."""
    ok = chosen.where(F.col("id").isNotNull()).join(known, [*by, "id"], "left_semi")
    first = ok.groupBy(*by, "id").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    return first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= cap)


def shortlist_batches(candidates: DataFrame, most: int, by: list[str], order: str = "id") -> DataFrame:
    """``batch``: candidates in order, ``most`` to a call."""
    put = ranked(candidates, by, [order])
    return put.withColumn("batch", F.floor((F.col("__n") - 1) / most).cast("long")).drop("__n", "__total", "__sum")


def accept_in_order(questions: DataFrame, wanted: int, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Status of questions judged one after the other: ``duplicate`` (text seen before, accepted or not), ``accepted``,
    ``rejected``, or ``unjudged`` once ``wanted`` are accepted. ``would_accept`` is the judge's decision."""
    put = questions.withColumn("__t", t.normalise(text))
    first = F.row_number().over(Window.partitionBy(*by, "__t").orderBy(*order)) == 1
    put = put.withColumn("__new", first)
    counted = (F.col("__new") & F.col("would_accept")).cast("long")
    before = F.coalesce(F.sum(counted).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    status = F.when(before >= wanted, "unjudged").when(~F.col("__new"), "duplicate").when(F.col("would_accept"), "accepted").otherwise("rejected")
    return put.withColumn("status", status).drop("__t", "__new")


def rounds_run(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Rounds that take place: up to and with the first that was judged and accepted nothing. ``rounds(<by>, round, failed,
    accepted)``; a failed round never ends the loop."""
    stop = ((~F.col("failed")) & (F.col("accepted") == 0)).cast("long")
    before = F.coalesce(F.sum(stop).over(Window.partitionBy(*by).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rounds.withColumn("__s", before).where("__s = 0").drop("__s")


def worst_modes(severities: DataFrame, by: str = "item_id") -> DataFrame:
    """``worst, mean, worst_mode``: the worst severity and the first mode, in their order, that has it."""
    # one number per mode, so that the aggregate stays a hash aggregate of plain doubles
    each = [F.max(F.when(F.col("mode") == m, F.col("severity"))).alias(m) for m in FAILURE_MODES]
    agg = severities.groupBy(by).agg(F.max("severity").alias("worst"), mean_severity().alias("mean"), *each)
    return agg.select(by, "worst", "mean", F.coalesce(*[F.when(F.col(m) == F.col("worst"), m) for m in FAILURE_MODES]).alias("worst_mode"))
