"""Model calls: one pluggable client, called from executors; everything around it is DataFrame work.

A call always yields a record. Results are keyed and written before anything builds on them, so a retried task repeats
calls but never doubles their results; turn speculation off for these stages.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import quality
from ..schemas import CALL, CALL_KINDS, DECISION, FAILURE_MODES, ITEM_BODY, SCOPES
from ..sources.files import lenient_json


@dataclass(frozen=True)
class Reply:
    text: str | None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class CallError(Exception):
    """A failed call: an HTTP status, or a timeout, or any other input/output error."""

    def __init__(self, message: str, status: int | None = None, timeout: bool = False):
        super().__init__(message)
        self.status, self.timeout = status, timeout

    @property
    def kind(self) -> str:
        s = self.status
        if s in (401, 403):
            return "AUTH"
        if s == 429:
            return "RATE_LIMIT"
        if s == 408 or self.timeout:
            return "TIMEOUT"
        return "BAD_REQUEST" if s is not None and 400 <= s < 500 else "TRANSPORT"


class ModelClient(Protocol):
    """Must be picklable; ``temperature`` is None where the provider's default is wanted."""

    def call(self, model: str, temperature: float | None, system: str, user: str) -> Reply: ...


def render(template: str, variables: dict[str, object]) -> str:
    """``{{name}}`` replaced by its value; unknown names stay."""
    for k, v in variables.items():
        template = template.replace("{{" + k + "}}", str(v))
    return template


def execute(client: ModelClient, stage: str, model: str, temperature: float | None, max_attempts: int, system: str, user: str, sleep=time.sleep) -> tuple[str | None, dict]:
    """Text (None if every attempt failed) and record. Permanent failures aren't tried again; waits double up to 30 s."""
    if max_attempts < 1:
        raise ValueError(f"at least one attempt is needed, got {max_attempts}")
    start, reply, error, kind, attempt = time.monotonic(), None, None, None, 0
    while attempt < max_attempts:
        attempt += 1
        try:
            reply = client.call(model, None if temperature is None or temperature != temperature else temperature, system, user)
            kind = error = None
            break
        except Exception as e:
            error, kind = str(e), e.kind if isinstance(e, CallError) else "TRANSPORT"
            if not CALL_KINDS[kind]:
                break
            if attempt < max_attempts:
                sleep(min(30.0, 2.0 ** (attempt - 1)))
    return (reply.text if reply else None), {
        "request_id": uuid.uuid4().hex, "stage": stage, "model": model, "prompt_tokens": reply and reply.prompt_tokens, "completion_tokens": reply and reply.completion_tokens,
        "wall_clock_ms": int((time.monotonic() - start) * 1000), "retry_count": attempt - 1, "outcome": "success" if reply else "error", "error_message": error, "failure_category": kind,
        "cache_read_tokens": None, "cache_write_tokens": None, "provider_cost": None, "provider_cost_currency": None,
    }


def call_models(prompts: DataFrame, client: ModelClient, stage: str, model: str, temperature: float | None, max_attempts: int, key: list[str]) -> DataFrame:
    """``prompts(<key>, system, user)`` -> ``<key>, response, call``."""
    schema = T.StructType([*[prompts.schema[k] for k in key], T.StructField("response", T.StringType()), T.StructField("call", CALL)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [execute(client, stage, model, temperature, max_attempts, s, u) for s, u in zip(f["system"], f["user"])]
            yield f[key].assign(response=[d[0] for d in done], call=[d[1] for d in done])

    return prompts.select(*key, "system", "user").mapInPandas(run, schema)


def with_failure(call: Column, label: Column) -> Column:
    """The call's record with a failure found in its content; a failure of its own stays."""
    return F.when(label.isNotNull() & call["failure_category"].isNull(), call.withField("failure_category", label)).otherwise(call)


GENERATED = T.StructType([T.StructField("questions", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("questionText", T.StringType()), T.StructField("options", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("correct", T.BooleanType())]))), T.StructField("explanation", T.StringType()), T.StructField("competency", T.StringType())])))])
JUDGED = T.StructType([T.StructField("modes", T.ArrayType(T.StructType([T.StructField("mode", T.StringType()), T.StructField("severity", T.DoubleType()), T.StructField("triggered", T.BooleanType()), T.StructField("justification", T.StringType())]))), T.StructField("rationale", T.StringType())])
SELECTED = T.StructType([T.StructField("chosen", T.ArrayType(T.LongType())), T.StructField("rejected", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("reason", T.StringType())]))), T.StructField("rationale", T.StringType())])


def _failure(response: Column, parsed: Column, nothing: Column, stage: str, none: str) -> Column:
    """Label of a reply that can't be used; null if the call itself failed or all is well."""
    blank = t.is_blank(response)
    return F.when(response.isNull() & F.col("call.failure_category").isNotNull(), None).when(blank, f"{stage}_EMPTY_RESPONSE").when(parsed.isNull(), f"{stage}_MALFORMED_JSON").when(nothing, none)


def generated_questions(replies: DataFrame, key: list[str], allowed: Column) -> DataFrame:
    """Replies of the generator -> one row per question: ``<key>, pos, item, competency, defect``. ``allowed``: the types asked
    for, a column of the replies."""
    parsed = lenient_json("response", GENERATED)
    put = replies.withColumn("__p", parsed).withColumn("__a", allowed).select(*key, "__a", F.posexplode("__p.questions").alias("pos", "q"))
    kind = F.lower(F.regexp_replace(t.strip("q.type"), "[_ ]", "-"))
    options = F.transform("q.options", lambda o: F.struct(t.strip(o["text"]).alias("text"), F.coalesce(o["correct"], F.lit(False)).alias("correct")))
    mapped = F.col("q").isNotNull() & kind.isin("single-choice", "multiple-choice", "true-false") & F.col("q.options").isNotNull()
    defect = quality.quiz_defect_of(F.coalesce(mapped, F.lit(False)), kind, F.col("__a"), F.col("q.title"), F.col("q.questionText"), options)
    full = F.transform(options, lambda o: F.struct(o["text"].alias("text"), o["correct"].alias("correct"), F.lit(None).cast("string").alias("hint"), F.lit(None).cast("string").alias("explanation")))
    item = F.struct(kind.alias("type"), t.strip("q.title").alias("title"), t.strip("q.questionText").alias("question_text"), full.alias("options"), F.lit(None).cast("string").alias("hint"), F.col("q.explanation").alias("explanation"))
    return put.select(*key, "pos", item.cast(ITEM_BODY).alias("item"), F.col("q.competency").alias("competency"), defect.alias("defect"))


def generation_failure(replies: DataFrame, usable: DataFrame, key: list[str]) -> DataFrame:
    """Replies with the label of what went wrong: the call, the reply, or that no question of it can be used."""
    p = lenient_json("response", GENERATED)
    ok = usable.where("defect is null").select(*key).distinct().withColumn("__ok", F.lit(True))
    label = _failure(F.col("response"), p, F.coalesce(F.size(p["questions"]) <= 0, F.lit(True)), "GENERATION", "GENERATION_NO_QUESTIONS")
    out = replies.withColumn("__l", label).join(ok, key, "left")
    found = F.coalesce("__l", F.when(F.col("call.failure_category").isNull() & F.col("__ok").isNull(), "VALIDATION_VIOLATION"))
    return out.withColumn("call", with_failure(F.col("call"), found)).drop("__l", "__ok")


def decisions(replies: DataFrame, key: list[str], scope: str, threshold: float, gating: tuple[str, ...] | None, model: str) -> DataFrame:
    """Replies of the judge -> ``<key>, decision, call``: verdicts tidied and complete, or the label of what is wrong."""
    modes, gate = SCOPES[scope], quality.gate_of(gating, scope)
    p = lenient_json("response", JUDGED)
    put = replies.withColumn("__p", p)
    raw = put.select(*key, F.posexplode("__p.modes").alias("ord", "m")).select(*key, "ord", "m.*")
    named = quality.normalise_verdicts(raw, scope, key)
    name = F.upper(F.translate(F.trim("mode"), " -", "__"))
    why = raw.select(*key, "ord", name.alias("mode"), "justification").groupBy(*key, "mode").agg(F.max_by("justification", "ord").alias("justification"))
    each = named.join(why, [*key, "mode"], "left")
    verdict = F.map_from_entries(F.collect_list(F.struct("mode", F.struct("severity", "triggered", "justification"))))
    worst = F.coalesce(F.max(F.when(F.col("mode").isin(*gate), F.col("severity"))), F.lit(0.0))
    agg = each.groupBy(*key).agg(verdict.alias("v"), worst.alias("w"), quality.mean_severity().alias("m"))
    score = 1 - F.col("w")
    out = put.join(agg, key, "left")
    decision = F.when(F.col("v").isNotNull(), F.struct((score >= threshold).alias("accepted"), score.alias("aggregate_score"), F.col("m").alias("mean_severity"), F.col("v").alias("mode_verdicts"), F.lit(model).alias("filter_model"), F.col("__p.rationale").alias("rationale")).cast(DECISION))
    label = _failure(F.col("response"), F.col("__p"), F.coalesce(F.size("__p.modes") <= 0, F.lit(True)), "FILTER", "FILTER_NO_MODES")
    label = F.coalesce(label, F.when(F.col("call.failure_category").isNull() & F.col("v").isNull(), "FILTER_INCOMPLETE_VERDICT"))
    assert set(modes) <= set(FAILURE_MODES)
    return out.select(*key, decision.alias("decision"), with_failure(F.col("call"), label).alias("call"))


def selections(replies: DataFrame, known: DataFrame, key: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """Replies of the selector -> chosen ids ``<key>, id, rank``, and the calls with what is wrong. ``known(<key>, id)``."""
    p = lenient_json("response", SELECTED)
    put = replies.withColumn("__p", p)
    chosen = quality.clean_selection(put.select(*key, F.posexplode("__p.chosen").alias("pos", "id")), known, cap, key)
    some = chosen.select(*key).distinct().withColumn("__ok", F.lit(True))
    label = _failure(F.col("response"), F.col("__p"), F.lit(False), "SELECT", "")
    calls = put.withColumn("__l", label).join(some, key, "left")
    label = F.coalesce("__l", F.when(F.col("call.failure_category").isNull() & F.col("__ok").isNull(), "SELECT_NO_CHOICE"))
    return chosen, calls.select(*key, with_failure(F.col("call"), label).alias("call"))


class EmbeddingClient(Protocol):
    """Must be picklable."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed(chunks: DataFrame, client: EmbeddingClient, text: str = "text", at_once: int = 64) -> DataFrame:
    """``chunks`` with ``embedding``, asked for in batches on the executors."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, out = f[text].fillna("").tolist(), []
            for i in range(0, len(texts), at_once):
                out += client.embed(texts[i : i + at_once])
            yield f.assign(embedding=out)

    return chunks.mapInPandas(run, schema)
