"""Workflows over the model operators: quizzes by rounds (agentic) or from a pool (two-phase), pool building, top-up.

Rounds are driver loops over batches of all open requests; each round's calls and questions are written before the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import pool, quality, store
from ..operators.export import render_options
from ..schemas import SCOPES
from . import model as m
from .prompts import FILTER_SYSTEM, GENERATE, GENERATE_SYSTEM, SELECT, SELECT_SYSTEM, judging


@dataclass(frozen=True)
class Role:
    """A model in a role, with the client that reaches it."""

    model: str
    client: m.ModelClient
    temperature: float | None = None
    max_attempts: int = 3


def fill(template: str, **columns) -> object:
    """The template with columns put in."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(t.col(c).cast("string"), F.lit("")))
    return out


def _judge(items: DataFrame, key: list[str], role: Role, scope: str, threshold: float, gating: tuple[str, ...] | None, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    asked = F.col("request") if "request" in items.columns else F.lit("(none)")
    prompt = fill(
        judging(scope), modes=F.lit(", ".join(SCOPES[scope])), request=asked, title="item.title", question="item.question_text",
        options=render_options("item.options"), grounding="grounding",
    )
    prompts = items.select(*key, F.lit(FILTER_SYSTEM).alias("system"), prompt.alias("user"))
    return keep(m.decisions(keep(m.call_models(prompts, role.client, "filter", role.model, role.temperature, role.max_attempts, key)), key, scope, threshold, gating, role.model))


def agentic(requests: DataFrame, generator: Role, judge: Role, keep: Callable[[DataFrame], DataFrame], threshold: float = 0.7, gating: tuple[str, ...] | None = None, max_rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Questions and calls of all requests, generated and judged round by round.

    ``requests(request_key, topic, types array, difficulty, instructions, n, grounding)``. Each round asks for what is
    missing; texts seen before are skipped, judged or not; the first judged round that adds nothing ends a request, a round
    whose generation failed doesn't. ``keep`` writes a DataFrame and reads it back.

    A ``by_competency`` column, where there is one, says which requests name competencies: each question tells its own then.

    Returns ``request_key, round, pos, item, competency, decision, status`` and ``request_key, round, call``.
    """
    gate = tuple(dict.fromkeys([*(gating or ()), *SCOPES["REQUEST_FIT"]])) if gating else None
    open_ = keep(requests.select("request_key", F.col("n").alias("missing")))
    questions = calls = None
    for round_ in range(1, max_rounds + 1):
        if open_.isEmpty():
            break
        now = requests.join(open_, "request_key")
        prompts = now.select("request_key", F.lit(GENERATE_SYSTEM).alias("system"), _asking(now).alias("user"))
        replies = keep(m.call_models(prompts, generator.client, "generation", generator.model, generator.temperature, generator.max_attempts, ["request_key"]))
        found = keep(m.generated_questions(replies.join(requests.select("request_key", "types"), "request_key"), ["request_key"], F.col("types")).withColumn("round", F.lit(round_)))
        made = m.generation_failure(replies, found, ["request_key"]).select("request_key", F.lit(round_).alias("round"), "call")
        usable = found.where("defect is null").withColumn("__t", t.normalise("item.question_text"))
        seen = usable.groupBy("request_key", "__t").agg(F.min("pos").alias("pos"))
        if questions is not None:
            seen = seen.join(questions.select("request_key", t.normalise("item.question_text").alias("__t")), ["request_key", "__t"], "left_anti")
        of = F.concat_ws("; ", F.array_join("types", ", "), "difficulty", "topic", "instructions")
        new = usable.join(seen, ["request_key", "__t", "pos"], "left_semi").drop("__t").join(requests.select("request_key", "grounding", of.alias("request")), "request_key")
        judged = _judge(keep(new), ["request_key", "round", "pos"], judge, "COMBINED", threshold, gate, keep)
        put = new.drop("grounding", "defect", "request").join(judged, ["request_key", "round", "pos"]).join(open_, "request_key")
        counted = put.where("decision is not null").withColumn("ok", F.col("decision.accepted"))
        before = F.coalesce(F.sum(F.col("ok").cast("int")).over(_order("request_key", "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # once a request has enough, the rest of its batch doesn't count
        status = counted.withColumn("before", before).where("before < missing").withColumn("status", F.when(F.col("ok"), "accepted").otherwise("rejected"))
        batch = keep(status.select("request_key", "round", "pos", "item", "competency", "decision", "status"))
        questions = batch if questions is None else keep(questions.unionByName(batch))
        spent = keep(made.unionByName(judged.select("request_key", "round", "call")))
        calls = spent if calls is None else calls.unionByName(spent)
        added = batch.where("status = 'accepted'").groupBy("request_key").agg(F.count(F.lit(1)).alias("added"))
        failed = made.where("call.failure_category is not null").select("request_key").withColumn("failed", F.lit(True))
        left = open_.join(added, "request_key", "left").join(failed, "request_key", "left").withColumn("added", F.coalesce("added", F.lit(0)))
        open_ = keep(left.where((F.col("added") < F.col("missing")) & (F.coalesce("failed", F.lit(False)) | (F.col("added") > 0))).select("request_key", (F.col("missing") - F.col("added")).alias("missing")))
    return questions, calls


def _asking(requests: DataFrame):
    """The prompt that asks for what a request is still missing."""
    put = {
        "count": "missing", "types": F.array_join("types", ", "), "difficulty": "difficulty", "topic": "topic",
        "instructions": F.coalesce("instructions", F.lit("(none)")), "grounding": "grounding",
    }
    plain = fill(GENERATE["topic"], **put)
    return F.when(F.col("by_competency"), fill(GENERATE["competencies"], **put)).otherwise(plain) if "by_competency" in requests.columns else plain


def _order(key: str, pos: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(pos)


def two_phase(requests: DataFrame, candidates: DataFrame, selector: Role, keep: Callable[[DataFrame], DataFrame], max_candidates: int = 40) -> tuple[DataFrame, DataFrame]:
    """Selections from pooled candidates and the calls. ``requests(request_key, n)``; ``candidates(request_key, id, item)``, each
    id once for a request. More than ``max_candidates`` are shortlisted in batches first."""

    def select(some: DataFrame, key: list[str], n: DataFrame) -> tuple[DataFrame, DataFrame]:
        line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("item.title"), F.lit("\n"), F.col("item.question_text"), F.lit("\n"), render_options("item.options"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("x")))), lambda x: x["x"]), "\n\n")
        prompts = some.groupBy(*key).agg(listed.alias("candidates")).join(n, "request_key")
        prompts = prompts.select(*key, F.lit(SELECT_SYSTEM).alias("system"), fill(SELECT, count="n", candidates="candidates").alias("user"))
        replies = keep(m.call_models(prompts, selector.client, "selection", selector.model, selector.temperature, selector.max_attempts, key))
        chosen, spent = m.selections(replies, some.select(*key, "id"), key, 1 << 30)
        return keep(chosen.join(n, "request_key").where("rank <= n").drop("n")), keep(spent.select("request_key", "call"))

    n = requests.select("request_key", "n")
    batches = quality.shortlist_batches(candidates, max_candidates, ["request_key"])
    many = batches.where("batch > 0").select("request_key").distinct()
    first, calls = select(batches.join(many, "request_key", "left_semi"), ["request_key", "batch"], n)
    short = candidates.join(many, "request_key", "left_anti").unionByName(candidates.join(first.select("request_key", "id"), ["request_key", "id"], "left_semi").select(*candidates.columns))
    chosen, more = select(short, ["request_key"], n)
    return chosen, calls.unionByName(more)


def build_pool(items: DataFrame, generator: Role, judge: Role, keep: Callable[[DataFrame], DataFrame], batch_size: int = 12, threshold: float = 0.7, gating: tuple[str, ...] | None = None) -> DataFrame:
    """Pending pool items generated in batches of a cell and judged: the items' next versions.

    ``items(item_id, cell_key, question_type, difficulty_band, grounding, <item columns>)``. Questions and items of a batch are
    paired by position; an item without one fails with its call's failure. A batch's call is recorded on its first item.
    """
    put = keep(pool.batches(items, batch_size, ["cell_key"], ["item_id"]))
    each = put.groupBy("cell_key", "batch").agg(F.count(F.lit(1)).alias("n"), F.first("question_type").alias("kind"), F.first("difficulty_band").alias("difficulty"), F.first("grounding").alias("grounding"))
    prompts = each.select("cell_key", "batch", F.lit(GENERATE_SYSTEM).alias("system"), fill(GENERATE["cell"], count="n", types="kind", difficulty="difficulty", topic="cell_key", instructions=F.lit("(none)"), grounding="grounding").alias("user"))
    key = ["cell_key", "batch"]
    replies = keep(m.call_models(prompts, generator.client, "generation", generator.model, generator.temperature, generator.max_attempts, key))
    found = m.generated_questions(replies.join(each.select(*key, "kind"), key), key, F.array("kind"))
    failed = m.generation_failure(replies, found, key).select(*key, "call")
    good = found.where("defect is null")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("pos")) - 1
    paired = keep(put.drop("item", "calls").join(good.select(*key, rank.alias("batch_pos"), "item"), [*key, "batch_pos"], "left").join(failed, key, "left"))
    judged = _judge(paired.where("item is not null").select("item_id", "item", "grounding"), ["item_id"], judge, "GENERAL", threshold, gating, keep)
    out = paired.join(judged.select("item_id", "decision", F.col("call").alias("judge_call")), "item_id", "left")
    state = F.when(F.col("item").isNull(), "FAILED_GENERATION").when(F.col("decision").isNull(), "FAILED_FILTER").otherwise("FILTERED")
    failure = F.when(F.col("item").isNull(), F.coalesce(F.col("call.failure_category"), F.lit("VALIDATION_VIOLATION"))).when(F.col("decision").isNull(), F.col("judge_call.failure_category"))
    calls = F.array_compact(F.array(F.when(F.col("batch_pos") == 0, F.col("call")), F.col("judge_call")))
    return out.select("item_id", "cell_key", "item", "decision", state.alias("state"), failure.alias("failure"), calls.alias("calls"))


def top_up(requests: DataFrame, make: Callable[[], DataFrame], grow: Callable[[DataFrame], None], rounds: int = 3) -> DataFrame:
    """Grow the pools of incomplete requests and select again, until all are complete, nothing is gained or rounds run out.

    ``make()`` gives ``request_key, accepted``; ``grow`` gets ``request_key, per_cell``. Requests have ``n`` and ``cells``.
    """
    state = make()
    for _ in range(rounds):
        missing = requests.join(state, "request_key", "left").withColumn("missing", F.col("n") - F.coalesce("accepted", F.lit(0))).where("missing > 0")
        if missing.isEmpty():
            break
        grow(missing.select("request_key", pool.top_up("missing", "cells").alias("per_cell")))
        after = make()
        gained = after.join(state.withColumnRenamed("accepted", "before"), "request_key", "left").where(F.col("accepted") > F.coalesce("before", F.lit(0)))
        state = after
        if gained.isEmpty():
            break
    return state


def sweep_progress(configurations: DataFrame, requests: DataFrame, repetitions: int, quizzes: DataFrame) -> DataFrame:
    """What a resumed sweep still has to make; a finished one gives no row, and so makes no call."""
    final = quizzes.withColumn("ok", store.final_quiz(F.size("questions"), F.transform("calls", lambda c: c["failure_category"]))).where("ok")
    return store.work_list(configurations, requests, repetitions, final)
