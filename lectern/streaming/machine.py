"""The item state machine over a stream of events, one keyed state an open item.

An item is enqueued, claimed for generation, generated, claimed for filtering and filtered; a failed attempt goes back one
stable state or fails for good, a failure that passes may be revived, and a claim that isn't answered in time goes back by
itself. What an event does depends on the item's state alone, so every item is a key with a small value state and a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import TRANSIENT_FAILURES

EVENT = "run_id string, item_id long, seq long, at timestamp, kind string, failure string"
KINDS = ("ENQUEUE", "CLAIM", "SUCCESS", "FAILURE", "REVIVE", "RELEASE")
_STATE = "state string, generation_attempts int, filter_attempts int, failure string, deadline long"
_CHANGE = "run_id string, item_id long, ms long, seq long, cause string, from_state string, state string, generation_attempts int, filter_attempts int, failure string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """``attempts`` of a stage at most; failures that no retry mends; a claim is stale after ``stale_ms``."""

    attempts: int = 3
    permanent: tuple[str, ...] = ("AUTH", "BAD_REQUEST")
    stale_ms: int = 3_600_000

    def after(self, now: Row | None, kind: str, failure: str | None, at: int) -> Row | None:
        """The item after an event at ``at`` (milliseconds), or nothing if the event doesn't apply in its state."""
        if now is None:
            return Row(state="PENDING", generation_attempts=0, filter_attempts=0, failure=None, deadline=None) if kind == "ENQUEUE" else None
        state, generating = now.state, now.state in ("PENDING", "GENERATING", "FAILED_GENERATION")
        counters = [now.generation_attempts, now.filter_attempts]
        to, why, deadline = None, now.failure, None
        if kind == "CLAIM" and state in ("PENDING", "GENERATED"):
            to, deadline = ("GENERATING" if generating else "FILTERING"), at + self.stale_ms
        elif kind in ("SUCCESS", "FAILURE") and state in ("GENERATING", "FILTERING"):
            tried = counters[not generating] + 1
            counters[not generating] = tried
            if kind == "SUCCESS":
                to, why = ("GENERATED" if generating else "FILTERED"), None
            elif tried < self.attempts and failure not in self.permanent:
                to, why = ("PENDING" if generating else "GENERATED"), failure
            else:
                to, why = ("FAILED_GENERATION" if generating else "FAILED_FILTER"), failure
        elif kind in ("RELEASE", "STALE") and state in ("GENERATING", "FILTERING"):
            to = "PENDING" if generating else "GENERATED"
        elif kind == "REVIVE" and state in ("FAILED_GENERATION", "FAILED_FILTER"):
            counters[not generating] = 0
            to, why = ("PENDING" if generating else "GENERATED"), None
        if to is None:
            return None
        return Row(state=to, generation_attempts=counters[0], filter_attempts=counters[1], failure=why, deadline=deadline)

    @staticmethod
    def closed(item: Row) -> bool:
        """No event can change the item any more: it is filtered, or failed for a reason that doesn't pass."""
        return item.state == "FILTERED" or (item.state.startswith("FAILED") and item.failure not in TRANSIENT_FAILURES)


_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


class ItemMachine(StatefulProcessor):
    """Applies a key's events in the order of their time and number. A claim whose time is up goes back before a later event
    is looked at, or when the watermark passes it, whichever comes first; the result is the same."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", _STATE)

    def _load(self) -> Row | None:
        found = self.item.get()
        return found and Row(**dict(zip(_FIELDS, found)))

    def _save(self, was: Row | None, now: Row | None) -> None:
        before, after = was and was.deadline, now and now.deadline
        if before != after and before is not None:
            self.handle.deleteTimer(before)
        if now is None:
            self.item.clear()
        elif now != was:
            self.item.update(tuple(now))
        if before != after and after is not None:
            self.handle.registerTimer(after)

    def _change(self, key, was: Row | None, to: Row, ms: int, seq: int | None, cause: str) -> Row:
        return Row(
            run_id=key[0], item_id=key[1], ms=ms, seq=seq, cause=cause, from_state=was and was.state, state=to.state,
            generation_attempts=to.generation_attempts, filter_attempts=to.filter_attempts, failure=to.failure,
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = now = self._load()
        # one item's new events: a few, as a stage has few attempts
        for e in sorted(rows, key=lambda e: (e.ms, e.seq is not None, e.seq or 0)):
            if now and now.deadline is not None and e.ms >= now.deadline:
                back = self.rules.after(now, "STALE", None, now.deadline)
                yield self._change(key, now, back, now.deadline, None, "STALE")
                now = back
            to = self.rules.after(now, e.kind, e.failure, e.ms)
            if to:
                yield self._change(key, now, to, e.ms, e.seq, e.kind)
                now = None if self.rules.closed(to) else to
        self._save(was, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        was, ms = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if was and was.deadline == ms:
            back = self.rules.after(was, "STALE", None, ms)
            self.item.update(tuple(back))  # the timer itself is gone
            yield self._change(key, was, back, ms, None, "STALE")

    def close(self) -> None:
        pass


def transitions(events: DataFrame, rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:
    """A stream of ``EVENT`` rows as the stream of state changes they cause: ``run_id, item_id, at, seq`` (none of a claim that
    went back by itself, whose ``cause`` is ``STALE``), ``cause, from_state, state, generation_attempts, filter_attempts, failure``.

    Events that don't apply in an item's state change nothing: a claim of a claimed item, an answer without a claim, any
    event of an unknown item but its enqueueing. Events with a null key, time or kind are left out. An item's events may
    come in any order inside a trigger; those of an earlier trigger are over, and later ones than the watermark are dropped.

    State is held for open items alone: one that is filtered, or has failed for a reason that doesn't pass, is forgotten.
    Enqueue against the stored items, then, since an ``ENQUEUE`` of a forgotten item begins it anew.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    known = events.where("run_id is not null and item_id is not null and at is not null and kind is not null")
    # timers count in milliseconds
    timed = known.withColumn("at", F.date_trunc("MILLISECOND", "at")).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    changes = timed.groupBy("run_id", "item_id").transformWithState(ItemMachine(rules), _CHANGE, "Append", "EventTime")
    return changes.select("run_id", "item_id", F.timestamp_millis("ms").alias("at"), *changes.columns[3:])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log, a folder of Parquet files, as a stream."""
    return spark.readStream.schema(EVENT).parquet(path)


def advance(spark: SparkSession, log: str, checkpoint: str, out: str, rules: Rules = Rules(), late: str = "0 seconds") -> list:
    """Work off what is new in the log, append the changes to ``out`` exactly once, and stop. A run that was broken off, or
    ended, is taken up where the checkpoint stands; call it by a schedule, or after each write to the log. The progress of
    its batches comes back, with the number of open items among them."""
    writer = transitions(read_log(spark, log), rules, late).writeStream.format("parquet").outputMode("append")
    query = writer.option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)


def states(changes: DataFrame) -> DataFrame:
    """Each item as its last change left it."""
    rest = [c for c in changes.columns if c not in ("run_id", "item_id")]
    last = changes.groupBy("run_id", "item_id").agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("r"))
    return last.select("run_id", "item_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def replay(events: DataFrame, folder: str, slices: int = 3, rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:
    """All changes that a batch of events causes, by way of the stream: the log is written a span of time after the other, and
    the query is started anew after each."""
    spark = events.sparkSession
    first, last = events.agg(F.min("at"), F.max("at")).first()
    at = lambda i: first + (last - first) * i / slices
    for i in range(slices if first else 0):
        span = (F.col("at") >= F.lit(at(i))) & (F.lit(i == slices - 1) | (F.col("at") < F.lit(at(i + 1))))
        events.where(span).write.mode("append").parquet(f"{folder}/log")
        advance(spark, f"{folder}/log", f"{folder}/checkpoint", f"{folder}/changes", rules, late)
    if not first:
        return spark.createDataFrame([], _CHANGE.replace("ms long", "at timestamp"))
    return spark.read.parquet(f"{folder}/changes")


def count_states(spark: SparkSession, changes: str, checkpoint: str, out: str) -> None:
    """Work off what is new in a folder of changes into ``out``: how many items of each run are in each state. A change adds
    one to its state and takes one from the state before, so what is kept are a few sums a run and no item. Each batch writes
    its own partition ``batch``; one that is repeated after a failure replaces it, and readers never see half of one."""
    schema = spark.read.parquet(changes).schema
    each = spark.readStream.schema(schema).parquet(changes)
    moves = F.explode(F.array(F.struct(F.col("state").alias("s"), F.lit(1).alias("d")), F.struct(F.col("from_state").alias("s"), F.lit(-1).alias("d"))))
    sums = each.select("run_id", moves.alias("m")).where("m.s is not null").groupBy("run_id", F.col("m.s").alias("state")).agg(F.sum("m.d").alias("items"))

    def publish(counts: DataFrame, batch: int) -> None:
        counts.where("items <> 0").coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = sums.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).foreachBatch(publish).start().awaitTermination()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """``run_id, state, items`` of the newest batch that :func:`count_states` wrote."""
    every = spark.read.parquet(out)
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")
