"""Reports derived from the store: cost, break-even, phases, thresholds, composition, failures, progress.

Money stays in doubles. Calls are rows ``(model, stage, prompt_tokens, completion_tokens, wall_clock_ms, failure_category)``.
Dimensions (prices, thresholds, buckets) are fixed small tables.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..schemas import FAILURE_MODES, OPEN_STATES, thresholds
from .quality import worst_modes

# Fixed values.
BUCKETS = (("0%", 0.0, 0.0), ("1-25%", 0.0, 0.25), ("26-50%", 0.25, 0.5), (">50%", 0.5, 1.0))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with ``priced, token_eur, billed_ms`` and the tokens that are billed. ``prices(model, billing, input_eur,
    output_eur)`` is a catalogue: one row a model."""
    out = calls.join(prices, "model", "left")
    by_token = F.col("billing") == "tokens"
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    eur = n("prompt_tokens") / F.lit(1_000_000.0) * F.col("input_eur") + n("completion_tokens") / F.lit(1_000_000.0) * F.col("output_eur")
    return out.withColumns({
        "priced": F.col("billing").isNotNull(), "token_eur": F.when(by_token, eur).otherwise(F.lit(0.0)),
        "billed_ms": F.when(F.col("billing") == "gpu-time", n("wall_clock_ms")).otherwise(F.lit(0)), "billed_prompt": F.when(by_token, n("prompt_tokens")).otherwise(F.lit(0)),
        "billed_completion": F.when(by_token, n("completion_tokens")).otherwise(F.lit(0)),
    })


def cost(calls: DataFrame, prices: DataFrame, by: list[str], gpu_low: float, gpu_high: float) -> DataFrame:
    """Cost of each group: low and high (GPU hours at two rates), tokens, GPU time, exactness, models without a price.
    Failed calls cost too."""
    return _total(_sums(priced(calls, prices), by).withColumn("models", F.array_join("models", ",")), gpu_low, gpu_high)


def _sums(calls: DataFrame, by: list[str]) -> DataFrame:
    """What priced calls of a group add up to, and the models without a price."""
    return calls.groupBy(*by).agg(
        F.sum("token_eur").alias("token_eur"), F.sum("billed_prompt").alias("prompt_tokens"), F.sum("billed_completion").alias("completion_tokens"),
        F.sum("billed_ms").alias("billed_ms"), F.array_sort(F.collect_set(F.when(~F.col("priced"), F.coalesce("model", F.lit("null"))))).alias("models"),
    )


def _total(sums: DataFrame, gpu_low: float, gpu_high: float) -> DataFrame:
    hours = F.col("billed_ms") / F.lit(3_600_000.0)
    out = sums.withColumns({"low_eur": F.col("token_eur") + hours * gpu_low, "high_eur": F.col("token_eur") + hours * gpu_high, "exact": F.col("billed_ms") == 0})
    return out.drop("token_eur").withColumnRenamed("models", "unpriced_models")


def mid(low="low_eur", high="high_eur") -> Column:
    return (F.col(low) + F.col(high)) / 2


def cost_per_configuration(items: DataFrame, runs: DataFrame, calls: DataFrame, prices: DataFrame, gpu_low: float, gpu_high: float) -> DataFrame:
    """Items, accepted, failed and cost of each configuration over the registered runs: completed and failed items count,
    those of runs that were never registered (pools) don't. Per accepted item: null without one."""
    ended = items.where(F.col("state").isin("FILTERED", "FAILED_GENERATION", "FAILED_FILTER"))
    seen = ended.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    # calls are summed up by item first, so that items are read and met once
    one = seen.join(_sums(priced(calls, prices), ["item_id"]), "item_id", "left")
    done = F.col("state") == "FILTERED"
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    agg = one.groupBy("configuration_id").agg(
        F.sum(done.cast("long")).alias("items"), F.sum((done & F.coalesce(F.col("accepted"), F.lit(False))).cast("long")).alias("accepted"), F.sum((~done).cast("long")).alias("failed"),
        n("token_eur"), n("prompt_tokens"), n("completion_tokens"), n("billed_ms"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("models")))), ",").alias("models"),
    )
    out = _total(agg, gpu_low, gpu_high)
    per = lambda c, n, none: F.when(F.col(n) == 0, none).otherwise(F.col(c) / F.col(n))
    none = F.lit(None).cast("double")
    return out.withColumns({"per_item_low": per("low_eur", "items", F.lit(0.0)), "per_item_high": per("high_eur", "items", F.lit(0.0)), "per_accepted_low": per("low_eur", "accepted", none), "per_accepted_high": per("high_eur", "accepted", none)})


def quiz_cost(quizzes: DataFrame, calls: DataFrame, prices: DataFrame, gpu_low: float, gpu_high: float) -> DataFrame:
    """Quizzes, cost and middle cost per quiz of each configuration; calls carry ``configuration_id``."""
    n = quizzes.groupBy("configuration_id").agg(F.count(F.lit(1)).alias("quizzes"))
    out = n.join(cost(calls, prices, ["configuration_id"], gpu_low, gpu_high), "configuration_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("low_eur", "high_eur")})
    return out.withColumn("mid_per_quiz", mid() / F.col("quizzes"))


def pool_cost(pool_calls: DataFrame, verdict_calls: DataFrame, generators: DataFrame, prices: DataFrame, gpu_low: float, gpu_high: float, scoped: bool = False) -> DataFrame:
    """Cost per (generator, model) of each pool. All verdict calls of the store are charged to every pool, as they are not told
    apart by pool; ``scoped=True`` charges those whose ``generator`` is known to their own pool only."""
    own = pool_calls.select("generator", "model", "prompt_tokens", "completion_tokens", "wall_clock_ms")
    if scoped:
        every = verdict_calls.select("generator", "model", "prompt_tokens", "completion_tokens", "wall_clock_ms").join(generators, "generator", "left_semi")
    else:
        # summed by model first: what is repeated for each generator is a few rows
        every = priced(verdict_calls, prices).groupBy("model").agg(F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.sum(F.coalesce("wall_clock_ms", F.lit(0))).alias("wall_clock_ms"))
        every = every.crossJoin(F.broadcast(generators.select("generator"))).select("generator", "model", "prompt_tokens", "completion_tokens", "wall_clock_ms")
    return cost(own.unionByName(every), prices, ["generator", "model"], gpu_low, gpu_high)


def amortisation(configurations: DataFrame, quiz_costs: DataFrame, pools: DataFrame) -> DataFrame:
    """Break-even of each two-phase configuration against the first agentic one.

    ``configurations(ord, configuration_id, approach, generator, generator_model, judge_model)``. The pool's share counts the
    generator's and the judge's models, once if they are the same. -1: never.
    """
    per = quiz_costs.where("quizzes > 0").select("configuration_id", "mid_per_quiz")
    agentic = configurations.where("approach = 'agentic'").orderBy("ord").limit(1).select(F.col("configuration_id").alias("against"))
    agentic = agentic.join(per.select(F.col("configuration_id").alias("against"), F.col("mid_per_quiz").alias("agentic_mid")), "against")
    two = configurations.where("approach = 'two-phase'").join(per.withColumnRenamed("mid_per_quiz", "two_phase_mid"), "configuration_id").crossJoin(F.broadcast(agentic))
    share = pools.select("generator", "model", mid().alias("eur"))
    used = two.join(share, "generator", "left").withColumn("eur", F.when((F.col("model") == F.col("generator_model")) | (F.col("model") == F.col("judge_model")), F.col("eur")).otherwise(F.lit(0.0)))
    out = used.groupBy("configuration_id", "against", "agentic_mid", "two_phase_mid").agg(F.coalesce(F.sum("eur"), F.lit(0.0)).alias("pool_mid"))
    margin = F.col("agentic_mid") - F.col("two_phase_mid")
    return out.withColumn("break_even", F.when(margin <= 0, F.lit(-1)).otherwise(F.ceil(F.col("pool_mid") / margin)).cast("long"))


def phase_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens per (configuration, stage), without a stage ``unknown``."""
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return calls.groupBy("configuration_id", F.coalesce("stage", F.lit("unknown")).alias("stage")).agg(F.count(F.lit(1)).alias("calls"), n("prompt_tokens").alias("prompt_tokens"), n("completion_tokens").alias("completion_tokens"))


def selection_ratio(quizzes: DataFrame) -> DataFrame:
    """Questions per pooled candidate of each configuration, 0 without candidates."""
    s = quizzes.groupBy("configuration_id").agg(F.sum("questions").alias("questions"), F.sum("candidate_count").alias("candidates"))
    return s.withColumn("selection_ratio", F.when(F.col("candidates") == 0, F.lit(0.0)).otherwise(F.col("questions") / F.col("candidates")))


def threshold_sweep(severities: DataFrame, steps: list[float] | None = None) -> DataFrame:
    """``step, threshold, total, accepted, accepted_mean`` of each threshold, and ``worst_<mode>`` counts among the rejects.

    Items are first counted by how many thresholds their worst and their mean severity pass, so what meets the thresholds is
    bounded by their number, however many values severities take.
    """
    spark = severities.sparkSession
    all_ = steps or thresholds()
    ts = [(i, x, sum(y <= x for y in all_)) for i, x in enumerate(all_)]
    ts = spark.createDataFrame(ts, "step long, threshold double, needed int")
    passed = lambda c: reduce(add, ((1 - F.col(c) >= F.lit(x)).cast("int") for x in all_))
    w = worst_modes(severities).select(passed("worst").alias("by_worst"), passed("mean").alias("by_mean"), "worst_mode")
    w = w.groupBy("by_worst", "by_mean", "worst_mode").agg(F.count(F.lit(1)).alias("n"))
    ok, ok_mean = F.col("by_worst") >= F.col("needed"), F.col("by_mean") >= F.col("needed")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    modes = [n(~ok & (F.col("worst_mode") == m)).alias(f"worst_{m.lower()}") for m in FAILURE_MODES]
    counts = w.join(F.broadcast(ts), how="cross").groupBy("step", "threshold")
    return counts.agg(F.sum("n").alias("total"), n(ok).alias("accepted"), n(ok_mean).alias("accepted_mean"), *modes)


def bucket_of(fraction: Column) -> Column:
    """Label of a solution share: exactly none, or the band whose upper end it reaches; missing counts as none."""
    f = F.coalesce(fraction, F.lit(0.0))
    out = F.when(f == 0, BUCKETS[0][0])
    for label, lo, hi in BUCKETS[1:]:
        out = out.when((f > lo) & (f <= hi), label)
    return out


def crosstab(items: DataFrame, severities: DataFrame, by: str, labels: list[str] | None = None) -> DataFrame:
    """Items, accepted and mean severity of each mode per value of ``by``; modes that don't occur are null. With ``labels``
    every one has a row, in that order (``position``)."""
    n = items.groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.sum(F.coalesce(F.col("accepted"), F.lit(False)).cast("long")).alias("accepted"))
    modes = [F.avg(F.when(F.col("mode") == m, F.col("severity"))).alias(f"mean_{m.lower()}") for m in FAILURE_MODES]
    s = items.select("item_id", by).join(severities, "item_id").groupBy(by).agg(*modes)
    out = n.join(s, by, "left")
    if labels:
        dim = items.sparkSession.createDataFrame(list(enumerate(labels)), f"position long, {by} string")
        out = F.broadcast(dim).join(out, by, "left").withColumn("items", F.coalesce("items", F.lit(0))).withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    return out


def failures(items: DataFrame, calls: DataFrame, by: str = "run_id") -> DataFrame:
    """``<by>, kind, category, n``: failed attempts by ``stage:category`` over completed and failed items alike, and
    permanent failures by ``state:failure``."""
    seen = items.where(F.col("state").isin("FILTERED", "FAILED_GENERATION", "FAILED_FILTER"))
    bad = calls.where(F.col("failure_category").isNotNull()).join(seen.select("item_id", by), "item_id")
    attempts = bad.groupBy(by, F.concat_ws(":", "stage", "failure_category").alias("category")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("attempt"))
    lost = seen.where("state <> 'FILTERED'").groupBy(by, F.concat_ws(":", "state", F.coalesce("failure", F.lit("null"))).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return attempts.unionByName(lost.withColumn("kind", F.lit("permanent"))).select(by, "kind", "category", "n")


def failure_totals(items: DataFrame, calls: DataFrame, by: str = "run_id") -> DataFrame:
    """Completed and failed items, calls and the share of failed calls."""
    seen = items.where(F.col("state").isin("FILTERED", "FAILED_GENERATION", "FAILED_FILTER"))
    n = seen.groupBy(by).agg(F.sum((F.col("state") == "FILTERED").cast("long")).alias("completed"), F.sum((F.col("state") != "FILTERED").cast("long")).alias("failed"))
    c = calls.join(seen.select("item_id", by), "item_id").groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.count("failure_category").alias("failed_calls"))
    out = n.join(c, by, "left").withColumn("calls", F.coalesce("calls", F.lit(0))).withColumn("failed_calls", F.coalesce("failed_calls", F.lit(0)))
    return out.withColumn("failed_call_rate", F.when(F.col("calls") == 0, F.lit(0.0)).otherwise(F.col("failed_calls") / F.col("calls")))


def state_counts(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"))


def progress(items: DataFrame, by: list[str]) -> DataFrame:
    """Progress of each group: done, awaiting the judge, to generate, failed, whole per cent finished, completeness."""
    n = lambda *s: F.sum(F.col("state").isin(*s).cast("long"))
    out = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), n("FILTERED").alias("done"), n("GENERATED", "FILTERING").alias("awaiting_judge"), n("PENDING", "GENERATING").alias("to_generate"),
        n("FAILED_GENERATION", "FAILED_FILTER").alias("failed"), (n(*OPEN_STATES) == 0).alias("complete"),
    )
    return out.withColumn("percent", F.expr("(done + failed) * 100 div total"))


def attempt_totals(attempts: DataFrame) -> DataFrame:
    return attempts.agg(F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("correct"))


def run_recency(quizzes: DataFrame) -> DataFrame:
    """Runs with quizzes, the most recent first (``position``)."""
    out = quizzes.groupBy("run_id").agg(F.max("created_at").alias("latest"), F.count(F.lit(1)).alias("quizzes"))
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc("latest"), "run_id")).cast("long"))


def pool_summary(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row about a pool: generated and failed items, competencies, and the judges that decided about it."""
    judges = verdicts.join(items.select("item_id"), "item_id", "left_semi").agg(F.array_join(F.array_sort(F.collect_set("judge_model")), ",").alias("judges"))
    made = F.col("state").isin("GENERATED", "FILTERING", "FILTERED", "FAILED_FILTER")
    n = items.agg(F.coalesce(F.sum(made.cast("long")), F.lit(0)).alias("generated"), F.coalesce(F.sum((~made).cast("long")), F.lit(0)).alias("not_generated"), F.count_distinct("competency_key").alias("competencies"))
    return n.crossJoin(judges)


def judges_of_generators(configurations: DataFrame) -> DataFrame:
    """Judges of each two-phase generator in the order of the configurations, each once; the first is the primary one."""
    two = configurations.where("approach = 'two-phase'")
    first = two.groupBy("generator", "judge").agg(F.min("ord").alias("ord"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "judge")))["judge"]
    out = first.groupBy("generator").agg(listed.alias("judges"))
    return out.withColumn("primary_judge", F.element_at("judges", 1))


def cost_table(costs: DataFrame) -> DataFrame:
    """The cells of the cost report of :func:`cost_per_configuration`, as they are printed."""
    rate = F.when(F.col("items") > 0, F.col("accepted") / F.col("items"))
    of = lambda name: t.band(f"{name}low{'_eur' if not name else ''}", f"{name}high{'_eur' if not name else ''}")
    return costs.select(
        "configuration_id", "items", "accepted", "failed", t.percent(rate).alias("accept_rate"), of("").alias("total_eur"), of("per_item_").alias("eur_per_item"),
        of("per_accepted_").alias("eur_per_accepted"),
    )


def export_totals(items: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: completed items of the registered runs, accepted ones, and their configurations."""
    done = items.where("state = 'FILTERED'").join(runs.select("run_id").distinct(), "run_id", "left_semi")
    each = done.groupBy("configuration_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("accepted"), F.lit(False)).cast("long")).alias("ok"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(zero("n").alias("items"), zero("ok").alias("accepted"), F.count(F.lit(1)).alias("configurations"))


def generation_totals(questions: DataFrame) -> DataFrame:
    """``configuration_id, generated, accepted`` of ``questions(configuration_id, accepted)`` made at request time."""
    return questions.groupBy("configuration_id").agg(F.count(F.lit(1)).alias("generated"), F.sum(F.coalesce(F.col("accepted"), F.lit(False)).cast("long")).alias("accepted"))
