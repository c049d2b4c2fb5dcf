"""The event log as a batch table and as a stream: sequences, replay, progress, windows.

Batch forms and streaming forms share their definitions; windows and sessions over event time extend the log for use at scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Events kept of each task for late subscribers.
RING = 2000


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of event files in a folder, with the schema given, never inferred."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def type_summary(events: DataFrame, key: str = "user_id") -> DataFrame:
    return events.groupBy(key, "event_type").agg(F.count(F.lit(1)).alias("n"))


def task_state(log: DataFrame, task: str, sequence: str, done: str) -> DataFrame:
    """Per task: number of events, largest sequence number, and whether an event of type ``done`` is among them."""
    return log.groupBy(task).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.max(sequence), F.lit(0)).alias("max_sequence"), (F.count_if(F.col("event_type") == done) > 0).alias("has_done"))


def replay(log: DataFrame, task: str, order: list[str], start: int, limit: int | None = None) -> DataFrame:
    """Events of each task from sequence number ``start`` on, at most ``limit`` a task."""
    w = Window.partitionBy(task).orderBy(*order)
    out = log.withColumn("sequence", F.row_number().over(w)).where(F.col("sequence") >= start)
    return out.where(F.col("sequence") < start + limit) if limit else out


def latest_progress(events: DataFrame, task: str = "user_id") -> DataFrame:
    """Last phase and value of each task, and when it began and last changed; partial aggregation, no window."""
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    g = events.groupBy(task).agg(last.alias("l"), F.min("ts").alias("started"), F.max("ts").alias("changed"), F.count(F.lit(1)).alias("events"))
    return g.select(task, F.col("l.event_type").alias("phase"), F.col("l.value").alias("progress"), "started", "changed", "events")


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by type in windows of event time; ``late`` sets the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str | None = None) -> DataFrame:
    """Sessions of a key: events at most ``gap`` apart."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str) -> DataFrame:
    """Events of a stream, each id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def numbered(events: DataFrame, task: str = "user_id") -> DataFrame:
    """Stream of (task, event_id, ts, event_type, sequence): numbers go on from 1 for each task, kept as state between micro-batches.

    Within a micro-batch events are numbered by time and id. The state of a task is one number.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        whole = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
        out = whole.assign(sequence=range(last + 1, last + 1 + len(whole)))
        state.update((last + len(whole),))
        yield out[[task, "event_id", "ts", "event_type", "sequence"]]

    slim = events.select(task, "event_id", "ts", "event_type")
    return slim.groupBy(task).applyInPandasWithState(number, f"{task} long, event_id long, ts timestamp, event_type string, sequence long", "last long", "append", "NoTimeout")


def bounded_replay(events: DataFrame, task: str = "user_id", keep: int = RING, terminal: str | None = None) -> DataFrame:
    """Stream of each task's kept events as (task, kept, first_id, last_id, done): a ring of the newest ``keep`` ids as state, dropped at the terminal event."""

    def ring(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        newest, done = [], False
        for b in batches:  # of a micro-batch of any size only the newest ``keep`` events are held
            newest = sorted([*newest, *zip(b["ts"], b["event_id"])])[-keep:]
            done = done or bool(terminal and (b["event_type"] == terminal).any())
        kept = (kept + [int(x) for _, x in newest])[-keep:]
        if done:
            state.remove()
        else:
            state.update((kept,))
        yield pd.DataFrame({task: [key[0]], "kept": [len(kept)], "first_id": [kept[0]], "last_id": [kept[-1]], "done": [done]})

    slim = events.select(task, "event_id", "ts", "event_type")
    return slim.groupBy(task).applyInPandasWithState(ring, f"{task} long, kept int, first_id long, last_id long, done boolean", "ids array<long>", "update", "NoTimeout")


def offered(events: DataFrame, slots: int = 500, task: str = "user_id") -> DataFrame:
    """What a slow subscriber of each task gets of a batch: the oldest ``slots`` events; newer ones are dropped and counted."""
    w = Window.partitionBy(task).orderBy("ts", "event_id")
    placed = events.withColumn("slot", F.row_number().over(w))
    dropped = placed.groupBy(task).agg(F.greatest(F.max("slot") - slots, F.lit(0)).alias("dropped"))
    return placed.where(F.col("slot") <= slots).join(dropped, task)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into a Parquet folder, exactly once by the checkpoint, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
