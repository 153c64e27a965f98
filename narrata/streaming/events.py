"""Streaming extension: event windows and value changes over Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.shipping import shared_base


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(day, event_type, n, total): tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): session windows per user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def value_changes(attributes: DataFrame) -> DataFrame:
    """Changed values of a stream of (story_id, entity, scene_no, value): the state holds the last scene and value of each entity."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (0, None)
        out = []
        for rows in batches:
            for r in rows.sort_values("scene_no").itertuples():
                if last[1] is not None and r.scene_no > last[0] and r.value != last[1]:
                    out.append((key[0], key[1], last[0], last[1], r.scene_no, r.value))
                if r.scene_no >= last[0]:
                    last = (r.scene_no, r.value)
        state.update((int(last[0]), last[1]))
        yield pd.DataFrame(out, columns=["story_id", "entity", "previous_scene", "previous", "scene_no", "value"])

    return attributes.groupBy("story_id", "entity").applyInPandasWithState(
        step, "story_id long, entity string, previous_scene int, previous string, scene_no int, value string", "scene_no int, value string", "append", "NoTimeout")


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now and returns its last (complete) or all (append) rows, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_base(spark)}/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        target = f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
