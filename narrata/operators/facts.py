"""Facts over time: what earlier scenes established, and where later ones differ.

Time is the scene number within a story.  Everything is keyed by story, so one
plan covers all stories; windows over "all earlier scenes" replace loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata import schema
from narrata.functions import text


def prior_pairs(left: DataFrame, right: DataFrame, story: str = "story_id", scene: str = "scene_no") -> DataFrame:
    """Range self-join: each row with every row of an earlier scene of its story (columns of ``right`` prefixed prior_)."""
    prior = right.select([F.col(c).alias(f"prior_{c}") for c in right.columns])
    return left.join(prior, (F.col(story) == F.col(f"prior_{story}")) & (F.col(f"prior_{scene}") < F.col(scene)))


def accumulate(scenes: DataFrame, value: str, story: str = "story_id", scene: str = "scene_no") -> DataFrame:
    """Adds ``prior``: the values of all earlier scenes in order; the first scene has none."""
    w = Window.partitionBy(story).orderBy(scene).rowsBetween(Window.unboundedPreceding, -1)
    return scenes.withColumn("prior", F.collect_list(value).over(w))


def value_changes(attributes: DataFrame) -> DataFrame:
    """Rows whose value differs from the entity's last one for the attribute; adds previous, previous_scene, distance."""
    w = Window.partitionBy("story_id", "entity", "attr").orderBy("scene_no")
    out = attributes.withColumn("previous", F.lag("value").over(w)).withColumn("previous_scene", F.lag("scene_no").over(w))
    return out.filter("previous <> value").withColumn("distance", F.col("scene_no") - F.col("previous_scene"))


def history(attributes: DataFrame, before: int | None = None) -> DataFrame:
    """(story_id, entity, history): an entity's assertions by scene, 'S1: a=1, b=2 | S2: a=3', optionally before a scene."""
    rows = attributes if before is None else attributes.filter(F.col("scene_no") < before)
    by_scene = rows.groupBy("story_id", "entity", "scene_no").agg(F.array_sort(F.collect_list(F.concat_ws("=", "attr", "value"))).alias("kv"))
    line = F.concat(F.lit("S"), F.col("scene_no").cast("string"), F.lit(": "), F.array_join("kv", ", "))
    pieces = by_scene.groupBy("story_id", "entity").agg(F.array_sort(F.collect_list(F.struct("scene_no", line.alias("line")))).alias("p"))
    return pieces.select("story_id", "entity", F.array_join(F.transform("p", lambda x: x["line"]), " | ").alias("history"))


def node_text(name, description):
    return F.when(F.trim(F.coalesce(description, F.lit(""))) == "", name).otherwise(F.concat(name, F.lit(" — "), F.trim(description)))


def edge_text(source, relation, target):
    return F.concat(F.lit("("), source, F.lit(") -["), relation, F.lit("]-> ("), target, F.lit(")"))


def candidate_facts(nodes: DataFrame, edges: DataFrame, attributes: DataFrame, most: int = 25) -> DataFrame:
    """(story_id, scene_no, pos, kind, text, name): attributes, then durable nodes, then durable lasting relations.

    A text counts once per scene, where it comes first; at most ``most`` per
    scene (the verifier's budget, a feature).  Nodes and edges carry ``pos``.
    """
    a = attributes.select("story_id", "scene_no", F.lit(0).alias("class"), "pos", F.lit("attribute").alias("kind"),
                          F.concat(F.col("entity"), F.lit("."), F.col("attr"), F.lit(" = "), F.col("value")).alias("text"), F.col("entity").alias("name"))
    t = node_text(F.col("name"), F.col("description"))
    n = nodes.filter(~F.col("type").isin("Location", "TimePoint") & text.is_durable(t)).select("story_id", "scene_no", F.lit(1).alias("class"), "pos", F.lower("type").alias("kind"), t.alias("text"), "name")
    names = nodes.select("story_id", "scene_no", "id", "name")
    s, g = names.toDF("story_id", "scene_no", "source", "source_name"), names.toDF("story_id", "scene_no", "target", "target_name")
    e = edges.drop("source_name", "target_name").filter(~F.col("relation").isin(*schema.TRANSIENT)).join(s, ["story_id", "scene_no", "source"], "left").join(g, ["story_id", "scene_no", "target"], "left")
    line = edge_text(F.coalesce("source_name", "source"), F.col("relation"), F.coalesce("target_name", "target"))
    r = e.filter(text.is_durable(line)).select("story_id", "scene_no", F.lit(2).alias("class"), "pos", F.lit("relation").alias("kind"), line.alias("text"), line.alias("name"))
    rows = a.unionByName(n).unionByName(r)
    once = rows.groupBy("story_id", "scene_no", "text").agg(F.min_by(F.struct("class", "pos", "kind", "name"), F.struct("class", "pos")).alias("f"))
    order = Window.partitionBy("story_id", "scene_no").orderBy("f.class", "f.pos", "text")
    return once.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).select("story_id", "scene_no", "pos", "f.kind", "text", "f.name")


def prior_summary(nodes: DataFrame, edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """(story_id, scene_no, lines): what a scene establishes for later ones: all events, durable entities, lasting relations, attributes."""
    tag = F.concat(F.lit("S"), F.col("scene_no").cast("string"), F.lit(": "))
    t = node_text(F.col("name"), F.col("description"))
    n = nodes.filter(~F.col("type").isin("Location", "TimePoint") & ((F.col("type") == "Event") | text.is_durable(t))).select(
        "story_id", "scene_no", F.lit(0).alias("class"), "pos", F.concat(tag, F.lit("["), F.lower("type"), F.lit("] "), t).alias("line"))
    names = nodes.select("story_id", "scene_no", "id", "name")
    s, g = names.toDF("story_id", "scene_no", "source", "source_name"), names.toDF("story_id", "scene_no", "target", "target_name")
    e = edges.drop("source_name", "target_name").filter(~F.col("relation").isin(*schema.TRANSIENT)).join(s, ["story_id", "scene_no", "source"], "left").join(g, ["story_id", "scene_no", "target"], "left")
    r = e.select("story_id", "scene_no", F.lit(1).alias("class"), "pos", F.concat(tag, edge_text(F.coalesce("source_name", "source"), F.col("relation"), F.coalesce("target_name", "target"))).alias("line"))
    a = attributes.select("story_id", "scene_no", F.lit(2).alias("class"), "pos", F.concat(tag, F.lit("[attr] "), F.col("entity"), F.lit("."), F.col("attr"), F.lit(" = "), F.col("value")).alias("line"))
    rows = n.unionByName(r).unionByName(a).groupBy("story_id", "scene_no").agg(F.array_sort(F.collect_list(F.struct("class", "pos", "line"))).alias("l"))
    return rows.select("story_id", "scene_no", F.transform("l", lambda x: x["line"]).alias("lines"))
