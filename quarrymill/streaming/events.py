"""Structured Streaming over event files: windows, live status, batched sinks.

Every query here runs over what is there (``availableNow``) and gives what the batch form of
the same aggregation gives; on a live source the same functions keep running.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from quarrymill.staging import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "1 day"


def event_stream(spark: SparkSession, directory: str, files_each: int = 1000) -> DataFrame:
    """events as a stream; ``ts`` as a timestamp, since watermarks need one."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).parquet(f"{directory}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str) -> DataFrame:
    by = events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sliding_counts(events: DataFrame, width: str, step: str) -> DataFrame:
    by = events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step))
    return by.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def session_counts(events: DataFrame, gap: str) -> DataFrame:
    by = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def live_status(events: DataFrame) -> DataFrame:
    """Counters of everything seen so far."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def run_updates(result: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs a streaming aggregation over all present input and returns the last row of each of its groups.

    In update mode a micro-batch gives only the groups that it changed, and groups that the
    watermark has passed leave the state. Each micro-batch writes a folder of its own, which a
    rerun after a failure replaces.
    """
    spark, folder = result.sparkSession, f"{shared_folder(result.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = (
        result.writeStream.outputMode("update")
        .foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/result/batch={number}"))
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    updates = spark.read.schema(f"{_ddl(result)}, batch int").parquet(f"{folder}/result")
    others = [c for c in result.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*[c if c in keys else F.col(f"last.{c}").alias(c) for c in result.columns])


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def run_available(result: DataFrame, name: str) -> DataFrame:
    """Runs a streaming aggregation over all present input and returns its last complete result.

    For session windows, which update mode does not take; all sessions stay in the state. Each
    micro-batch replaces the table as a whole, so a rerun after a failure leaves one result.
    """
    folder = f"{shared_folder(result.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = (
        result.writeStream.outputMode("complete")
        .foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/result"))
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/result")


def run_closed(result: DataFrame, name: str) -> DataFrame:
    """Runs a streaming query over all present input in append mode and returns what it has closed.

    Windows and sessions come once, when the watermark has passed them, and leave the state
    with that: it holds no more than what is still open, however long the stream runs.
    """
    spark, folder = result.sparkSession, f"{shared_folder(result.sparkSession)}/{name}-{uuid.uuid4().hex}"
    append_batches(result, f"{folder}/result", f"{folder}/progress")
    return spark.read.schema(result.schema).parquet(f"{folder}/result")


FLUSHED = "key long, session_start timestamp, flush int, n int, first_id long, last_id long, by string"
OPEN = "session_start long, flush int, n int, first_id long, last_id long, last_us long"


def flushes(most: int, idle_us: int):
    """A state function for applyInPandasWithState: one buffer for each key, flushed when full or when idle.

    The state is six numbers, whatever passes by. Rows (key, event_id, ts) of a micro-batch are
    taken in order of time; a gap beyond ``idle_us`` flushes as the timer would have.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, flush, n, first, last, last_us = state.get if state.exists else (None, 0, 0, None, None, None)
        out: list[tuple] = []

        def close(by: str) -> None:
            nonlocal flush, n, first
            if n:
                out.append((key[0], pd.Timestamp(start, unit="us"), flush, n, first, last, by))
                flush, n, first = flush + 1, 0, None

        if state.hasTimedOut:
            close("idle")
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for at, event in zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["event_id"].tolist(), strict=True):
                if last_us is None or at - last_us > idle_us:
                    close("idle")
                    start, flush = at, 0
                first, last, last_us, n = event if first is None else first, event, at if last_us is None else max(last_us, at), n + 1
                if n == most:
                    close("full")
            state.update((start, flush, n, first, last, last_us))
            # Never in the past: late rows within the watermark may come when it has passed the timer.
            state.setTimeoutTimestamp(max((last_us + idle_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in FLUSHED.split(", ")])

    return run


def flushed_buffers(events: DataFrame, key: str, most: int, idle_seconds: int, late: str = LATE) -> DataFrame:
    """key, session_start, flush (from 0 in a session), n, first_id, last_id, by ('full' or 'idle').

    Events of a key are buffered and flushed at ``most`` of them, or when the key has been idle
    for so long by the watermark, which closes its session and drops its state. What has been
    idle for less stays open. Rows should come no later than ``late``.
    """
    rows = events.withWatermark("ts", late).select(F.col(key).cast("long").alias("key"), "event_id", "ts")
    return rows.groupBy("key").applyInPandasWithState(flushes(most, idle_seconds * 1_000_000), FLUSHED, OPEN, "append", "EventTimeTimeout")


def append_batches(rows: DataFrame, path: str, progress: str) -> None:
    """Appends a stream's rows to a Parquet table in micro-batches, each exactly once."""
    rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(path).awaitTermination()
