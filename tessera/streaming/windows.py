"""Structured Streaming over an event table: windows, sessions, dedupe, latest state, change feed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", late: str = "2 days") -> DataFrame:
    """The events below ``folder`` as a stream with event time ``ts`` and a watermark."""
    at = spark.read.parquet(f"{folder}/{name}")
    raw = spark.readStream.schema(at.schema).option("pathGlobFilter", f"{name}*").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame) -> DataFrame:
    """One event an effect key: later ones with the same key are dropped while the watermark remembers it."""
    return events.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def latest_state(events: DataFrame) -> DataFrame:
    newest = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(newest.alias("state"), F.count("*").alias("n_events"))


def running_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(F.floor("value")).alias("delivered"))


def run_to_end(stream: DataFrame, shared: str, mode: str = "complete", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result as a table in the shared folder.

    In complete mode each batch replaces the table; in append mode batches add to it,
    each under its own number, so that a batch that runs again replaces itself."""
    spark, at = stream.sparkSession, f"{shared}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch = each(batch) if each else batch
        batch.write.mode("overwrite").parquet(f"{at}/rows" if mode == "complete" else f"{at}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{at}/rows")
    return done.drop("batch") if mode != "complete" else done
