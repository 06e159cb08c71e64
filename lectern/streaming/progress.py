"""Live views of a run over its event log: every change of an item's state is an event ``(item_id, run_id, state, seq, at)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports

EVENT = "item_id long, run_id string, state string, seq long, at timestamp"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The log as a stream of Parquet files."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def current_states(events: DataFrame) -> DataFrame:
    """The state of each item: that of its last event by number. Late and repeated events change nothing."""
    return events.groupBy("run_id", "item_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def progress_now(events: DataFrame) -> DataFrame:
    """Progress of each run from a (batch) event log."""
    return reports.progress(current_states(events), ["run_id"])


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per run, state and window of time; events later than ``late`` are past."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "run_id", "state").agg(F.count(F.lit(1)).alias("events"))


def watch(events: DataFrame, name: str, checkpoint: str | None = None):
    """Start a query that keeps each run's progress in the table ``name``: item states are the streaming state, and each
    batch's full table is summed up and replaces the view."""
    writer = current_states(events).writeStream.outputMode("complete")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)

    def publish(states: DataFrame, _: int) -> None:
        reports.progress(states, ["run_id"]).write.mode("overwrite").saveAsTable(name)

    return writer.foreachBatch(publish).start()
