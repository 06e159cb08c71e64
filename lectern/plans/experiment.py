"""Experiments as jobs over the store: pools are built, quizzes assembled, and what is stored isn't made again.

An experiment is a plan of configurations, requests and repetitions. Running it is idempotent: pool cells get the items they
lack, pending items are generated and judged, judges add the verdicts they haven't given, and quizzes are made for the part of
the work list that isn't final. So resuming is running it again, and a finished experiment makes no call. All requests of a
configuration are worked on together; what is looped over are the plan's configurations, generators and judges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import export, pool, reports, store
from ..schemas import DIFFICULTIES
from ..scratch import written
from ..sources.config import ConfigError, Request, RunPlan, SweepPlan
from . import workflow as w

CELL = pool.CELL


@dataclass
class Experiment:
    """``roles`` by model key; ``grounding`` has ``request_key, grounding``, ``material`` has ``course_key, competency_key,
    grounding`` for pool items, ``documents`` has ``course_key, document, content_hash`` and ``retrieved`` has ``competency_key,
    chunk_id``. ``keep`` writes a DataFrame and reads it back."""

    spark: SparkSession
    store: store.Store
    plan: SweepPlan
    requests: list[Request]
    roles: dict[str, w.Role]
    grounding: DataFrame
    material: DataFrame
    documents: DataFrame
    retrieved: DataFrame
    threshold: float = 0.7
    gating: tuple[str, ...] | None = None
    max_output_attempts: int = 3
    keep: Callable[[DataFrame], DataFrame] = field(default=written)

    def __post_init__(self):
        needed = {m for c in self.plan.configurations for m in (c.generator, c.judge, c.selector)}
        if missing := sorted(needed - set(self.roles)):
            raise ConfigError(f"no model for {', '.join(missing)}")
        if any(c.approach == "two-phase" for c in self.plan.configurations) and not all(r.competency_mode for r in self.requests):
            raise ConfigError("two-phase configurations answer requests for competencies only")

    # -- the run

    def fingerprint(self) -> str:
        """What the experiment reads and asks: documents by their hashes, requests and repetitions."""
        of = export.fingerprint(self.documents, ["course_key", "document"], ["course_key", "document", "content_hash"]).first().fingerprint
        asked = "\n".join([of, str(self.plan.repetitions), *map(repr, self.requests)])
        return "sweep-fingerprint=" + hashlib.sha256(asked.encode()).hexdigest()

    def run(self) -> dict[str, int]:
        """Register (an error if the same name was run over other inputs), build the pools, assemble; how many of each were made."""
        self.store.register(self.plan.sweep, "sweep", self.fingerprint())
        built = self.build_pools()
        return {"items": built, "quizzes": self.assemble()}

    # -- pools

    def judges(self) -> dict[str, list[str]]:
        """The judges of each generator that pools are built for; the first of them is the build's own."""
        rows = [(i, c.approach, c.generator, c.judge) for i, c in enumerate(self.plan.configurations)]
        df = self.spark.createDataFrame(rows, "ord int, approach string, generator string, judge string")
        return {r.generator: list(r.judges) for r in reports.judges_of_generators(df).collect()}  # a row a generator

    def cells(self) -> DataFrame:
        """The pool grid: the competencies that requests name, by language, type and difficulty."""
        named = list(dict.fromkeys((r.course_key, k) for r in self.requests for k in r.competency_keys))
        side = lambda name, xs: self.spark.createDataFrame(list(enumerate(xs)), f"ord int, {name} string")
        comps = self.spark.createDataFrame([(i, *x) for i, x in enumerate(named)], "ord int, course_key string, competency_key string")
        p = self.plan
        return pool.grid(comps, side("language", p.languages), side("question_type", p.question_types), side("difficulty_band", p.difficulties))

    def build_pools(self) -> int:
        made = 0
        for generator, judges in self.judges().items():
            changed = pool.changed_documents(self.documents, self.store.read("document").select("document", "content_hash")) if self._built(generator) else self.documents.select("document").limit(0)
            sized = pool.targets(self.cells(), self._counts(generator), pool.touched(self.retrieved, changed), self.plan.items_per_cell, self._built(generator))
            made += self.enqueue(generator, pool.new_items(sized))
            self.work_off(generator, judges[0])
            for judge in judges[1:]:
                self.judge_with(generator, judge)
        if made:
            self.store.append("document", self.documents)
        return made

    def _items(self, generator: str) -> DataFrame:
        return self.store.read("item").where(F.col("configuration_id") == f"pool|{generator}")

    def _built(self, generator: str) -> bool:
        return not self._items(generator).isEmpty()

    def _counts(self, generator: str) -> DataFrame:
        return self._items(generator).groupBy(t.cell_key(*CELL).alias("cell_key")).agg(F.count(F.lit(1)).alias("n"))

    def enqueue(self, generator: str, items: DataFrame) -> int:
        """Pending items of cells, numbered on from what is there."""
        level = F.create_map(*[F.lit(x) for kv in DIFFICULTIES.items() for x in kv])
        new = items.select(
            F.xxhash64(F.lit(generator), "cell_key", "item_index").alias("item_id"), F.lit(f"pool-{generator}").alias("run_id"), F.lit(f"pool|{generator}").alias("configuration_id"),
            F.col("cell_key").alias("topic_key"), F.col("item_index").cast("int").alias("item_index"), *CELL, level[F.col("difficulty_band")].cast("int").alias("difficulty"),
            F.lit(self.roles[generator].model).alias("generator_model"),
        )
        return self.store.enqueue(self.keep(new))

    def work_off(self, generator: str, judge: str) -> None:
        """Generate and judge what is pending; an item that failed for a reason that may pass is tried again while attempts are left."""
        for _ in range(self.max_output_attempts):
            pending = self.keep(self._items(generator).where("state = 'PENDING'"))
            if pending.isEmpty():
                return
            put = pending.drop("decision", "state", "failure").withColumnRenamed("topic_key", "cell_key").join(self.material, ["course_key", "competency_key"], "left")
            done = self.keep(w.build_pool(put, self.roles[generator], self.roles[judge], self.keep, self.plan.generation_batch_size, self.threshold, self.gating))
            names = ("item", "decision", "state", "failure", "calls")
            after = pending.drop("item", "decision", "state", "failure").withColumnRenamed("calls", "spent").join(done.select("item_id", *names), "item_id")
            failed = F.col("state").startswith("FAILED")
            retry = failed & store.may_retry(F.col("generation_attempts"), self.max_output_attempts, F.col("failure"))
            calls = F.concat(F.coalesce("spent", F.array().cast(after.schema["calls"].dataType)), "calls")
            after = after.withColumns({
                "state": F.when(retry, "PENDING").otherwise(F.col("state")), "generation_attempts": F.coalesce("generation_attempts", F.lit(0)) + 1, "calls": calls,
                "filter_attempts": F.coalesce("filter_attempts", F.lit(0)) + F.col("item").isNotNull().cast("int"),
            })
            after = self.keep(after)
            self.store.append("item", after)
            told = after.where("decision is not null").select("item_id", F.lit(self.roles[judge].model).alias("judge_model"), F.lit("GENERAL").alias("scope"), F.col("decision.accepted").alias("accepted"), "decision")
            self.store.append("verdict", told)

    def judge_with(self, generator: str, judge: str) -> None:
        """Verdicts of another judge about the items it hasn't judged."""
        role = self.roles[judge]
        items = self._items(generator).where("item is not null")
        todo = self.keep(pool.missing_verdicts(items, self.store.read("verdict"), role.model).join(self.material, ["course_key", "competency_key"], "left"))
        if todo.isEmpty():
            return
        found = w._judge(todo.select("item_id", "item", "grounding"), ["item_id"], role, "GENERAL", self.threshold, self.gating, self.keep)
        told = found.where("decision is not null").select("item_id", F.lit(role.model).alias("judge_model"), F.lit("GENERAL").alias("scope"), F.col("decision.accepted").alias("accepted"), "decision", F.array("call").alias("calls"))
        self.store.append("verdict", self.keep(told))

    # -- quizzes

    def _requests(self) -> DataFrame:
        rows = [
            (r.key, r.course_key, r.language, list(r.question_types), r.number_of_questions, r.difficulty, r.topic or ", ".join(r.competency_keys), list(r.competency_keys), r.optional_prompt)
            for r in self.requests
        ]
        names = "asked string, course_key string, language string, types array<string>, n int, difficulty string, topic string, competency_keys array<string>, instructions string"
        out = self.spark.createDataFrame(rows, names)
        return out.join(self.grounding.withColumnRenamed("request_key", "asked"), "asked", "left")

    def work(self) -> DataFrame:
        """``configuration_id, request_key, repetition`` of the quizzes that aren't final."""
        c = self.spark.createDataFrame([(x.configuration_id,) for x in self.plan.configurations], "configuration_id string")
        r = self.spark.createDataFrame([(x.key,) for x in self.requests], "request_key string")
        mine = self.store.read("quiz").where(F.col("run_id") == self.plan.sweep)
        return w.sweep_progress(c, r, self.plan.repetitions, mine)

    def assemble(self) -> int:
        made, work = 0, self.keep(self.work())
        for c in self.plan.configurations:
            todo = work.where(F.col("configuration_id") == c.configuration_id)
            if todo.isEmpty():
                continue
            put = self._requests().join(todo.select(F.col("request_key").alias("asked"), "repetition"), "asked")
            # each repetition of a request is a request of its own while it is worked on
            put = self.keep(put.withColumn("request_key", F.concat_ws("#", "asked", "repetition")))
            quizzes = self.keep((self._agentic if c.approach == "agentic" else self._two_phase)(put, c))
            named = quizzes.join(put.select("request_key", "asked", "repetition", "course_key", "n"), "request_key")
            whole = named.select(
                F.concat_ws("-", F.lit(self.plan.sweep), F.lit(c.id), "asked", F.concat(F.lit("r"), F.col("repetition"))).alias("quiz_id"), F.lit(self.plan.sweep).alias("run_id"),
                F.lit(c.configuration_id).alias("configuration_id"), F.col("asked").alias("request_key"), "repetition", "course_key", (F.size("questions") >= F.col("n")).alias("complete"),
                "questions", "rejected", "calls", "candidate_count", F.current_timestamp().alias("created_at"),
            )
            # a quiz behind which a call never answered isn't stored, so that it is made again
            whole = self.keep(whole.where(store.storable_quiz(F.col("calls"))))
            made += whole.count()
            self.store.append("quiz", whole)
        return made

    def _quizzes(self, put: DataFrame, questions: DataFrame, calls: DataFrame, candidates: DataFrame | None) -> DataFrame:
        """One row a request: ``questions(request_key, place, accepted, question)`` and ``calls(request_key, call)``."""
        # by place alone: a question holds a map, which has no order
        before = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
        listed = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.struct("place", "question"))), before)["question"]
        q = questions.groupBy("request_key").agg(listed(F.col("accepted")).alias("questions"), listed(~F.col("accepted")).alias("rejected"))
        of = calls.groupBy("request_key").agg(F.collect_list("call").alias("calls"))
        out = put.select("request_key").join(q, "request_key", "left").join(of, "request_key", "left")
        if candidates is not None:
            out = out.join(candidates.groupBy("request_key").agg(F.count(F.lit(1)).cast("int").alias("candidate_count")), "request_key", "left")
        else:
            out = out.withColumn("candidate_count", F.lit(0))
        kind = q.schema["questions"].dataType
        none = F.array().cast(kind)
        return out.withColumns({
            "questions": F.coalesce("questions", none), "rejected": F.coalesce("rejected", none), "calls": F.coalesce("calls", F.array().cast(of.schema["calls"].dataType)),
            "candidate_count": F.coalesce("candidate_count", F.lit(0)),
        })

    def _agentic(self, put: DataFrame, c) -> DataFrame:
        asked = put.select("request_key", "topic", "types", "difficulty", "instructions", "n", "grounding", (F.size("competency_keys") > 0).alias("by_competency"))
        questions, calls = w.agentic(asked, self.roles[c.generator], self.roles[c.judge], self.keep, self.threshold, self.gating, self.plan.max_rounds)
        # a request for one competency needs no match; of several it is the one whose key the question names
        told = F.lower(t.strip(F.regexp_replace(F.coalesce("competency", F.lit("")), r"\s*\([^()]*\)$", "")))
        named = F.get(F.filter("competency_keys", lambda k: (F.size("competency_keys") == 1) | (F.lower(k) == told)), F.lit(0))
        q = questions.join(put.select("request_key", "competency_keys"), "request_key").select(
            "request_key", F.struct("round", "pos").alias("place"), (F.col("status") == "accepted").alias("accepted"),
            F.struct("item", "decision", named.alias("competency_key")).alias("question"),
        )
        return self._quizzes(put, q, calls.select("request_key", "call"), None)

    def _candidates(self, put: DataFrame, c) -> DataFrame:
        """Accepted pool items, by the configuration's judge, of the cells a request names."""
        wanted = put.select("request_key", "course_key", F.explode("competency_keys").alias("competency_key"), "language", "types", F.col("difficulty").alias("difficulty_band"))
        wanted = wanted.select("request_key", *[x for x in CELL if x != "question_type"], F.explode("types").alias("question_type"))
        ok = pool.candidates(self._items(c.generator).where("state = 'FILTERED' or item is not null"), self.store.read("verdict"), self.roles[c.judge].model, {})
        return ok.join(wanted, CELL).select("request_key", F.col("item_id").alias("id"), "item", "decision", "competency_key")

    def _two_phase(self, put: DataFrame, c) -> DataFrame:
        selector = self.roles[c.selector]
        rounds: list[DataFrame] = []
        latest: dict[str, DataFrame] = {}
        cells = F.size("competency_keys") * F.size("types")

        def select() -> DataFrame:
            found = self.keep(self._candidates(put, c))
            chosen, calls = w.two_phase(put.select("request_key", "n"), found.select("request_key", "id", "item"), selector, self.keep, self.plan.max_candidates)
            chosen = self.keep(chosen)
            rounds.append(self.keep(calls))
            latest.update(found=found, chosen=chosen)
            return chosen.groupBy("request_key").agg(F.count(F.lit(1)).alias("accepted"))

        def grow(missing: DataFrame) -> None:
            of = put.join(missing, "request_key").select("course_key", F.explode("competency_keys").alias("competency_key"), "language", "types", F.col("difficulty").alias("difficulty_band"), "per_cell")
            of = of.select("course_key", "competency_key", "language", F.explode("types").alias("question_type"), "difficulty_band", "per_cell")
            # requests that share a cell share what it grows by
            of = of.groupBy(*CELL).agg(F.max("per_cell").alias("more")).withColumn("cell_key", t.cell_key(*CELL)).join(self._counts(c.generator), "cell_key", "left")
            sized = of.withColumn("existing", F.coalesce("n", F.lit(0)).cast("long")).withColumn("target", F.col("existing") + F.col("more"))
            self.enqueue(c.generator, pool.new_items(sized))
            self.work_off(c.generator, c.judge)

        w.top_up(put.select("request_key", "n", cells.alias("cells")), select, grow, self.plan.top_up_rounds)
        picked = latest["chosen"].join(latest["found"], ["request_key", "id"])
        q = picked.select("request_key", F.struct("rank", "id").alias("place"), F.lit(True).alias("accepted"), F.struct("item", "decision", "competency_key").alias("question"))
        calls = rounds[0]
        for more in rounds[1:]:
            calls = calls.unionByName(more)
        return self._quizzes(put, q, calls, latest["found"])

    # -- exports

    def export_files(self, competencies: DataFrame) -> DataFrame:
        """``file, content`` of the experiment's evaluator input, for :func:`lectern.sources.exports.write_files`."""
        quizzes = self.store.read("quiz").where(F.col("run_id") == self.plan.sweep)
        return evaluator_files(self.spark, quizzes, self.requests, competencies)


def evaluator_files(spark: SparkSession, quizzes: DataFrame, requests: list[Request], competencies: DataFrame) -> DataFrame:
    """``file, content`` of stored quizzes: see :func:`lectern.operators.export.sweep_files`."""
    each = quizzes.select("quiz_id", F.posexplode("questions").alias("q_index", "q"))
    questions = each.select("quiz_id", "q_index", F.col("q.item.question_text").alias("text"), F.col("q.competency_key").alias("competency_key"))
    rows = [(r.key, r.course_key, r.language, r.topic or ", ".join(r.competency_keys), "UNDERSTAND") for r in requests]
    asked = spark.createDataFrame(rows, "request_key string, course_key string, language string, objectives string, bloom string")
    return export.sweep_files(quizzes.select("quiz_id", "request_key", "configuration_id"), questions, asked, competencies)


def run_plan(s: store.Store, plan: RunPlan, topics: DataFrame, roles: dict[str, w.Role], levels: tuple[int, ...] = tuple(DIFFICULTIES.values()), keep=written, **how) -> int:
    """Work off a run plan: for each configuration ``items-per-topic`` items of each of ``topics(position, topic, grounding)``, dealt
    to the topics in turn at levels in turn, generated and judged. What is there stays, so resuming is running it again; how
    many items were new."""
    n, made = topics.count(), 0
    for name, generator, judge in plan.configurations:
        put = pool.enqueue_round_robin(topics.select("position", "topic"), n * plan.items_per_topic)
        items = put.select(
            F.xxhash64(F.lit(plan.plan), F.lit(name), "topic", "item_index").alias("item_id"), F.lit(plan.plan).alias("run_id"), F.lit(name).alias("configuration_id"),
            F.col("topic").alias("topic_key"), F.col("item_index").cast("int").alias("item_index"), pool.ladder("item_index", list(levels)).alias("difficulty"), F.lit("single-choice").alias("question_type"),
        )
        made += s.enqueue(keep(items))
        pending = s.read("item").where((F.col("run_id") == plan.plan) & (F.col("configuration_id") == name) & (F.col("state") == "PENDING"))
        pending = keep(pending)
        if pending.isEmpty():
            continue
        # one call an item, as its level is its own
        asked = pending.drop("decision", "state", "failure").withColumn("cell_key", F.concat_ws("|", "topic_key", "item_index")).withColumn("difficulty_band", F.col("difficulty").cast("string"))
        asked = asked.join(topics.select(F.col("topic").alias("topic_key"), "grounding"), "topic_key", "left")
        done = keep(w.build_pool(asked, roles[generator], roles[judge], keep, 1, **how))
        names = ("item", "decision", "state", "failure", "calls")
        after = pending.drop(*names).join(done.select("item_id", *names), "item_id")
        after = after.withColumns({"generation_attempts": F.col("generation_attempts") + 1, "filter_attempts": F.col("filter_attempts") + F.col("item").isNotNull().cast("int")})
        s.append("item", keep(after))
    return made
