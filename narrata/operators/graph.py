"""Property-graph operators over node and edge tables.

Nodes: id, type, name (and aliases, description, scene_refs, evidence).  Edges:
source, relation, target (and evidence, confidence, scene_refs).  All are
set-based: a story or scene is a key column, never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata import schema
from narrata.functions import text
from narrata.shipping import cut


def typed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_type and target_type; null where the endpoint is not a node."""
    s = nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type"))
    t = nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type"))
    return edges.join(s, "source", "left").join(t, "target", "left")


def valid_edges(typed: DataFrame) -> DataFrame:
    """Edges whose triple the schema allows; the 48 triples are broadcast."""
    return typed.join(F.broadcast(schema.triples(typed.sparkSession)), ["source_type", "relation", "target_type"], "left_semi")


def violations(typed: DataFrame) -> DataFrame:
    """Edges between known nodes whose triple the schema does not allow; dangling ends are not violations."""
    both = typed.filter("source_type is not null and target_type is not null")
    return both.join(F.broadcast(schema.triples(typed.sparkSession)), ["source_type", "relation", "target_type"], "left_anti")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, relation, target): evidence (and scene_refs, where there) united and sorted, the greatest confidence."""
    united = [_united(c) for c in ("scene_refs",) if c in edges.columns]
    return edges.groupBy("source", "relation", "target").agg(_united("evidence"), F.max("confidence").alias("confidence"), *united)


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Reverse edges of symmetric relations and of precedes, where not there already."""
    turn = F.create_map(*[F.lit(x) for kv in schema.REVERSED.items() for x in kv])
    back = edges.filter(F.col("relation").isin(*schema.REVERSED)).select(
        F.col("target").alias("source"), turn[F.col("relation")].alias("relation"), F.col("source").alias("target"), "evidence", "confidence")
    return back.join(edges, ["source", "relation", "target"], "left_anti").dropDuplicates(["source", "relation", "target"])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends per node; ends are combined on the map side."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def repair_relations(typed: DataFrame) -> DataFrame:
    """Raw relations made valid: before and after become precedes (after turns the ends), caused_by turns into causes;
    an invalid relation is replaced where its types allow exactly one, else the edge goes.  Other columns are carried.
    """
    ends = ("source", "relation", "target", "source_type", "target_type")
    rest = [c for c in typed.columns if c not in ends]
    turned = F.col("relation").isin("after", "caused_by")
    swapped = typed.select(
        F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("relation").isin("before", "after"), "precedes").when(F.col("relation") == "caused_by", "causes").otherwise(F.col("relation")).alias("relation"),
        F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"),
        F.when(turned, F.col("target_type")).otherwise(F.col("source_type")).alias("source_type"),
        F.when(turned, F.col("source_type")).otherwise(F.col("target_type")).alias("target_type"), *rest)
    known = schema.triples(typed.sparkSession)
    only = known.groupBy("source_type", "target_type").agg(F.count("*").alias("n"), F.min("relation").alias("one")).filter("n = 1").drop("n")
    marked = swapped.join(F.broadcast(known.withColumn("ok", F.lit(True))), ["source_type", "relation", "target_type"], "left").join(F.broadcast(only), ["source_type", "target_type"], "left")
    return marked.withColumn("repaired", F.when(F.col("ok"), F.col("relation")).otherwise(F.col("one"))).filter("repaired is not null").select(
        "source", F.col("repaired").alias("relation"), "target", "source_type", "target_type", *rest)


def _united(col: str):
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(col)))).alias(col)


def merge_nodes(nodes: DataFrame, key: str = "key", order: str = "pos") -> DataFrame:
    """One node per key: first name, united sorted arrays (scene_refs and evidence, where there), longest description (the earliest of equals)."""
    first = F.struct(F.col(order))
    united = [_united(c) for c in ("scene_refs", "evidence") if c in nodes.columns]
    return nodes.groupBy(key).agg(
        F.min_by("id", first).alias("id"), F.min_by("name", first).alias("name"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
        F.max_by("description", F.struct(F.length("description"), -F.col(order))).alias("description"), F.count("*").alias("merged"), *united)


def resolve_ids(raw: DataFrame) -> DataFrame:
    """(raw_id, canonical): raw ids that stand for one canonical id only; ambiguous ones are left out."""
    return raw.groupBy("raw_id").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical")).filter("n = 1").drop("n")


def resolve_edges(edges: DataFrame, chunk_map: DataFrame, id_map: DataFrame, name_map: DataFrame) -> DataFrame:
    """Ends resolved by (chunk, raw id), else an unambiguous raw id, else type and name key; unresolved edges are dropped.

    ``edges``: chunk_id, source, source_type, source_name, relation, target, target_type, target_name.
    """
    out = edges
    for end in ("source", "target"):
        c = chunk_map.select(F.col("chunk_id"), F.col("raw_id").alias(end), F.col("canonical").alias(f"{end}_1"))
        i = id_map.select(F.col("raw_id").alias(end), F.col("canonical").alias(f"{end}_2"))
        n = name_map.select(F.col("key").alias(f"{end}_key"), F.col("canonical").alias(f"{end}_3"))
        key = F.concat_ws("::", F.col(f"{end}_type"), text.norm_graph(F.col(f"{end}_name"), F.col(f"{end}_type")))
        out = out.withColumn(f"{end}_key", key).join(c, ["chunk_id", end], "left").join(i, end, "left").join(n, f"{end}_key", "left")
        out = out.withColumn(f"{end}_id", F.coalesce(f"{end}_1", f"{end}_2", f"{end}_3")).drop(f"{end}_1", f"{end}_2", f"{end}_3", f"{end}_key")
    return out.filter("source_id is not null and target_id is not null and source_id <> target_id")


def uncovered_events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Events that no role edge (performs, undergoes, experiences) points at."""
    covered = edges.filter(F.col("relation").isin("performs", "undergoes", "experiences")).select(F.col("target").alias("id"))
    return nodes.filter("type = 'Event'").join(covered, "id", "left_anti")


def scene_subgraphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraphs of all scenes at once, as (scene, id) and (scene, edge...): a scene's nodes and edges, and the ends of its edges."""
    own = edges.withColumn("scene", F.explode("scene_refs"))
    ends = own.select("scene", F.explode(F.array("source", "target")).alias("id"))
    return nodes.select(F.explode("scene_refs").alias("scene"), "id").union(ends).distinct(), own


def scene_subgraph(nodes: DataFrame, edges: DataFrame, scene: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of one scene, and the ends of its edges."""
    ids, own = scene_subgraphs(nodes, edges)
    return nodes.join(ids.filter(F.col("scene") == scene), "id", "left_semi"), own.filter(F.col("scene") == scene).drop("scene")


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root): the least id that each node reaches; isolated nodes are their own.

    Least labels spread over edges and then jump to their own labels' labels, so
    the rounds grow with the logarithm of the longest path.  Each round is
    checkpointed to spark.checkpoint.dir.
    """
    both = cut(edges.select("source", "target").union(edges.select("target", "source")).distinct().toDF("a", "b"))
    labels = cut(nodes.select("id", F.col("id").alias("root")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        best = labels.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("above"))
        new = cut(best.join(up, "root", "left").select("id", "old", F.least("root", "above").alias("root")))
        labels = new.select("id", "root")
        if new.filter("old <> root").isEmpty():
            return labels
    raise RuntimeError("components did not converge")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, key, value): counts by type and relation (most frequent first within a metric), violations, evidence
    coverage, confidence over the edges that have one, average degree and, where nodes have them, aliases.

    Edges are typed and aggregated once, by relation; what is said about all of
    them is summed from there.
    """
    known = F.broadcast(schema.triples(nodes.sparkSession).withColumn("valid", F.lit(True)))
    typed = typed_edges(edges, nodes).join(known, ["source_type", "relation", "target_type"], "left")
    wrong = F.col("source_type").isNotNull() & F.col("target_type").isNotNull() & F.col("valid").isNull()
    e = typed.groupBy(F.coalesce("relation", F.lit("UNKNOWN")).alias("key")).agg(
        F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(F.size("evidence") > 0).alias("shown"), F.count("confidence").alias("sure"), F.sum("confidence").alias("confidence"))
    aliases = F.sum(F.size("aliases")) if "aliases" in nodes.columns else F.lit(None).cast("long")
    n = nodes.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("key")).agg(F.count("*").alias("n"), aliases.alias("aliases"))
    rows = n.select(F.lit("node").alias("of"), "key", "n", "aliases", *[F.lit(None).cast(t).alias(c) for c, t in (("wrong", "long"), ("shown", "long"), ("sure", "long"), ("confidence", "double"))]).unionByName(
        e.select(F.lit("edge").alias("of"), "key", "n", F.lit(None).cast("long").alias("aliases"), "wrong", "shown", "sure", "confidence"))
    # A row per type and relation is left: the sums of all and the rows themselves, as one list.
    node, edge = (F.sum(F.when(F.col("of") == x, F.col("n"))) for x in ("node", "edge"))
    metric = lambda name, key, value: F.struct(F.lit(name).alias("metric"), F.lit(key).alias("key"), value.cast("double").alias("value"))
    by = F.struct(F.when(F.col("of") == "node", "nodes_by_type").otherwise("edges_by_relation").alias("metric"), F.col("key").alias("key"), F.col("n").cast("double").alias("value"))
    all_ = rows.agg(
        F.collect_list(by).alias("by"),
        F.array(
            metric("schema_violations", "all", F.coalesce(F.sum("wrong"), F.lit(0))),
            metric("evidence_coverage", "edges", F.round(F.try_divide(100.0 * F.sum("shown"), edge), 1)),
            metric("avg_confidence", "edges", F.round(F.try_divide(F.sum("confidence"), F.sum("sure")), 3)),
            metric("avg_degree", "nodes", F.round(F.try_divide(2.0 * edge, node), 2)),
            *([metric("avg_aliases", "nodes", F.round(F.try_divide(F.sum("aliases") * 1.0, node), 2))] if "aliases" in nodes.columns else [])).alias("all"))
    ordered = F.array_sort("by", lambda x, y: F.when(x["metric"] != y["metric"], F.when(x["metric"] < y["metric"], -1).otherwise(1)).when(x["value"] != y["value"], F.when(x["value"] > y["value"], -1).otherwise(1)).otherwise(
        F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))
    return all_.select(F.inline(F.concat(ordered, "all")))


def next_of(df: DataFrame, by: str, order: list, value: str) -> DataFrame:
    """Adds ``next``: the following row's value within a key."""
    return df.withColumn("next", F.lead(value).over(Window.partitionBy(by).orderBy(*order)))
