"""Streaming and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.streaming import events as stream

from . import lifecycle
from .providers import StubProvider
from .registry import query, table


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """Tumbling day windows over the events as a stream (an extension)."""
    out = stream.run_available(stream.window_counts(stream.read_events(spark, f"{d}/events.parquet*")), "complete")
    return out.withColumn("total", F.round("total", 4))


def _stories(spark, d):
    """A user's days as scenes: 'Click has k 5.' for the last value of each type."""
    from .temporal import attributes

    line = F.concat(F.initcap("entity"), F.lit(" has "), F.col("attr"), F.lit(" "), F.col("value"), F.lit("."))
    rows = attributes(spark, d).groupBy(F.col("story_id").cast("string").alias("story_id"), "scene_no").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return rows.select("story_id", "scene_no", F.array_join("l", " ").alias("content"))


@query()
def replay_lifecycle(spark, d):
    """Profiles, proposals and batched verification with the stub provider, over all stories."""
    return lifecycle.detect(_stories(spark, d), StubProvider())


@query()
def replay_graph(spark, d):
    """Extraction and graph assembly with the stub provider: nodes and edges per scene."""
    nodes, edges = lifecycle.assemble(*lifecycle.extract(_stories(spark, d), StubProvider()))
    n = nodes.groupBy("story_id", "scene_no").agg(F.count("*").alias("nodes"))
    return n.join(edges.groupBy("story_id", "scene_no").agg(F.count("*").alias("edges")), ["story_id", "scene_no"], "left").na.fill(0)


@query("SELECT conv_id AS story_id, md5(string_agg('SCENE ' || (turn + 1) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS body FROM conversations GROUP BY conv_id")
def judge_prompts(spark, d):
    from .temporal import scenes

    return lifecycle.judge_prompt(scenes(spark, d).withColumnRenamed("text", "content")).select("story_id", F.md5("body").alias("body"))


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts >= p + INTERVAL 6 HOUR GROUP BY user_id")
def session_counts(spark, d):
    """Session windows per user over the batch table (an extension)."""
    return table(spark, d, "events").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))
