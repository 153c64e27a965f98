"""Graph queries: the star tables as a typed property graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata import schema
from narrata.functions import text
from narrata.operators import extraction, graph

from .registry import query, table

NODES_SQL = """
nodes AS (
  SELECT 'c' || c_custkey AS id, 'Character' AS type, c_name AS name FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Character', s_name FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'Event', 'order ' || o_orderkey FROM orders
  UNION ALL SELECT 'n' || n_nationkey, 'Location', n_name FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'Location', r_name FROM region
  UNION ALL SELECT DISTINCT 'd' || strftime(o_orderdate, '%Y-%m-%d'), 'TimePoint', strftime(o_orderdate, '%Y-%m-%d') FROM orders
  UNION ALL SELECT 'p' || p_partkey, 'Object', p_name FROM part
  UNION ALL SELECT DISTINCT 'g' || c_mktsegment, 'Concept', c_mktsegment FROM customer
  UNION ALL SELECT DISTINCT 'b' || p_brand, 'Concept', p_brand FROM part)"""

#: Raw edges hold wrong ones too: parts that possess suppliers, ends that are no node, orders that refer to themselves.
RAW_SQL = """
raw AS (
  SELECT 'c' || o_custkey AS source, 'performs' AS relation, 'o' || o_orderkey AS target, [o_orderpriority] AS evidence, 0.9::DOUBLE AS confidence FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'occurs_on', 'd' || strftime(o_orderdate, '%Y-%m-%d'), [o_orderpriority], 0.9 FROM orders
  UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, []::VARCHAR[], 1.0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'located_at', 'n' || c_nationkey, []::VARCHAR[], 0.8 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'located_at', 'n' || s_nationkey, []::VARCHAR[], 0.8 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'affiliated_with', 'g' || c_mktsegment, [c_mktsegment], 0.7 FROM customer
  UNION ALL SELECT 'p' || p_partkey, 'is_a', 'b' || p_brand, [p_type], 0.95 FROM part
  UNION ALL SELECT 's' || l_suppkey, 'possesses', 'p' || l_partkey, [l_linestatus], 1.0 - l_discount FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 'possesses', 's' || l_suppkey, []::VARCHAR[], 0.5 FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 's' || l_suppkey, 'uses', 'p' || (l_partkey + 1000000000), [l_returnflag], 0.4 FROM lineitem WHERE l_tax > 0.07
  UNION ALL SELECT 'o' || o_orderkey, 'references', 'o' || o_orderkey, []::VARCHAR[], 0.3 FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'o' || o_orderkey, 'precedes', 'o' || nxt, []::VARCHAR[], 0.6 FROM
    (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL)"""

EDGES_SQL = NODES_SQL + "," + RAW_SQL + f""",
triples AS (SELECT * FROM {schema.triples_sql()}),
typed AS (SELECT r.*, s.type AS source_type, t.type AS target_type FROM raw r LEFT JOIN nodes s ON r.source = s.id LEFT JOIN nodes t ON r.target = t.id),
good AS (SELECT t.* FROM typed t SEMI JOIN triples v USING (source_type, relation, target_type) WHERE t.source <> t.target),
edges AS (SELECT source, relation, target, list_sort(list_distinct(flatten(list(evidence)))) AS evidence, max(confidence) AS confidence FROM good GROUP BY ALL)"""


def _id(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def nodes(spark, d):
    """(id, type, name) of all tables."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders, customer, part = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "part")

    def of(df, kind, ident, name):
        return df.select(ident.alias("id"), F.lit(kind).alias("type"), name.alias("name"))

    parts = [
        of(customer, "Character", _id("c", "c_custkey"), F.col("c_name")),
        of(table(spark, d, "supplier"), "Character", _id("s", "s_suppkey"), F.col("s_name")),
        of(orders, "Event", _id("o", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))),
        of(table(spark, d, "nation"), "Location", _id("n", "n_nationkey"), F.col("n_name")),
        of(table(spark, d, "region"), "Location", _id("r", "r_regionkey"), F.col("r_name")),
        of(orders.select(day.alias("day")).distinct(), "TimePoint", _id("d", "day"), F.col("day")),
        of(part, "Object", _id("p", "p_partkey"), F.col("p_name")),
        of(customer.select("c_mktsegment").distinct(), "Concept", _id("g", "c_mktsegment"), F.col("c_mktsegment")),
        of(part.select("p_brand").distinct(), "Concept", _id("b", "p_brand"), F.col("p_brand")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_edges(spark, d):
    """Edges as claimed, wrong ones included: see RAW_SQL."""
    orders, customer, line = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem")
    none = F.array().cast("array<string>")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")

    def of(df, source, relation, target, evidence, confidence):
        return df.select(source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"), evidence.alias("evidence"), confidence.cast("double").alias("confidence"))

    chain = orders.withColumn("nxt", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("nxt is not null")
    parts = [
        of(orders, _id("c", "o_custkey"), "performs", _id("o", "o_orderkey"), F.array("o_orderpriority"), F.lit(0.9)),
        of(orders, _id("o", "o_orderkey"), "occurs_on", F.concat(F.lit("d"), day), F.array("o_orderpriority"), F.lit(0.9)),
        of(table(spark, d, "nation"), _id("n", "n_nationkey"), "part_of", _id("r", "n_regionkey"), none, F.lit(1.0)),
        of(customer, _id("c", "c_custkey"), "located_at", _id("n", "c_nationkey"), none, F.lit(0.8)),
        of(table(spark, d, "supplier"), _id("s", "s_suppkey"), "located_at", _id("n", "s_nationkey"), none, F.lit(0.8)),
        of(customer, _id("c", "c_custkey"), "affiliated_with", _id("g", "c_mktsegment"), F.array("c_mktsegment"), F.lit(0.7)),
        of(table(spark, d, "part"), _id("p", "p_partkey"), "is_a", _id("b", "p_brand"), F.array("p_type"), F.lit(0.95)),
        of(line, _id("s", "l_suppkey"), "possesses", _id("p", "l_partkey"), F.array("l_linestatus"), F.lit(1.0) - F.col("l_discount")),
        of(line.filter("l_returnflag = 'R'"), _id("p", "l_partkey"), "possesses", _id("s", "l_suppkey"), none, F.lit(0.5)),
        of(line.filter("l_tax > 0.07"), _id("s", "l_suppkey"), "uses", F.concat(F.lit("p"), (F.col("l_partkey") + 1000000000).cast("string")), F.array("l_returnflag"), F.lit(0.4)),
        of(orders.filter("o_orderstatus = 'F'"), _id("o", "o_orderkey"), "references", _id("o", "o_orderkey"), none, F.lit(0.3)),
        of(chain, _id("o", "o_orderkey"), "precedes", _id("o", "nxt"), none, F.lit(0.6)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark, d):
    """Valid edges, one per (source, relation, target), without self-loops."""
    raw = raw_edges(spark, d).filter("source <> target")
    return graph.dedupe_edges(graph.valid_edges(graph.typed_edges(raw, nodes(spark, d))))


@query(f"WITH {NODES_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_counts_by_type(spark, d):
    return nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def edge_counts_by_relation(spark, d):
    return edges(spark, d).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT source_type, relation, target_type, count(*) AS n FROM good GROUP BY ALL")
def valid_triples_semi(spark, d):
    raw = raw_edges(spark, d).filter("source <> target")
    return graph.valid_edges(graph.typed_edges(raw, nodes(spark, d))).groupBy("source_type", "relation", "target_type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT source_type, relation, target_type, count(*) AS n FROM typed ANTI JOIN triples USING (source_type, relation, target_type) WHERE source_type IS NOT NULL AND target_type IS NOT NULL GROUP BY ALL")
def schema_violations(spark, d):
    return graph.violations(graph.typed_edges(raw_edges(spark, d), nodes(spark, d))).groupBy("source_type", "relation", "target_type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT relation, source, target FROM typed WHERE source_type IS NULL OR target_type IS NULL")
def dangling_endpoints(spark, d):
    return graph.typed_edges(raw_edges(spark, d), nodes(spark, d)).filter("source_type is null or target_type is null").select("relation", "source", "target")


@query(f"WITH {EDGES_SQL} SELECT source, relation, target, array_to_string(evidence, '|') AS evidence, round(confidence, 4) AS confidence FROM edges")
def edge_dedupe_max_conf(spark, d):
    return edges(spark, d).select("source", "relation", "target", F.array_join("evidence", "|").alias("evidence"), F.round("confidence", 4).alias("confidence"))


@query(f"""WITH {EDGES_SQL} SELECT e.target AS source, CASE WHEN e.relation = 'precedes' THEN 'occurs_after' ELSE e.relation END AS relation, e.source AS target
FROM edges e WHERE e.relation IN ('precedes', 'kinship_with', 'affinity_with', 'hostility_with')""")
def reverse_edges(spark, d):
    return graph.reverse_edges(edges(spark, d)).select("source", "relation", "target")


@query("""SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS next_order, (row_number() OVER w)::INT AS pos,
date_diff('day', o_orderdate::DATE, (lead(o_orderdate) OVER w)::DATE)::INT AS gap_days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def precedes_chain(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("next_order"), F.row_number().over(w).alias("pos"),
                                            F.date_diff(F.lead("o_orderdate").over(w), "o_orderdate").alias("gap_days"))


@query(f"WITH {EDGES_SQL} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def degree_per_node(spark, d):
    return graph.degrees(edges(spark, d))


@query(f"WITH {EDGES_SQL} SELECT n.n AS nodes, e.n AS edges, round(2.0 * e.n / n.n, 2) AS avg_degree FROM (SELECT count(*) AS n FROM nodes) n, (SELECT count(*) AS n FROM edges) e")
def avg_degree(spark, d):
    n = nodes(spark, d).agg(F.count("*").alias("nodes"))
    e = edges(spark, d).agg(F.count("*").alias("edges"))
    return n.join(F.broadcast(e)).select("nodes", "edges", F.round(2.0 * F.col("edges") / F.col("nodes"), 2).alias("avg_degree"))


@query(f"WITH {EDGES_SQL} SELECT relation, round(100.0 * avg(CASE WHEN len(evidence) > 0 THEN 1.0 ELSE 0.0 END), 1) AS pct, round(avg(confidence), 3) AS avg_confidence FROM edges GROUP BY relation")
def evidence_coverage(spark, d):
    return edges(spark, d).groupBy("relation").agg(F.round(100.0 * F.avg(F.when(F.size("evidence") > 0, 1.0).otherwise(0.0)), 1).alias("pct"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


@query(f"SELECT source_type, target_type, string_agg(relation, ',' ORDER BY relation) AS relations, count(*) AS n FROM {schema.triples_sql()} GROUP BY ALL")
def relations_per_type_pair(spark, d):
    return schema.triples(spark).groupBy("source_type", "target_type").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"), F.count("*").alias("n"))


CLAIMS_SQL = """claims AS (
  SELECT 'o' || o_orderkey AS source, CASE o_orderstatus WHEN 'F' THEN 'after' WHEN 'O' THEN 'before' ELSE 'caused_by' END AS relation,
         'o' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target, 'Event' AS source_type, 'Event' AS target_type FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'happens_on', 'd' || o_orderkey, 'Event', 'TimePoint' FROM orders
  UNION ALL SELECT 'c' || o_custkey, 'performs', 'o' || o_orderkey, 'Character', 'Event' FROM orders
  UNION ALL SELECT 'c' || o_custkey, 'ordered', 'o' || o_orderkey, 'Character', 'Event' FROM orders)"""


@query(f"""WITH {CLAIMS_SQL}, t AS (SELECT * FROM {schema.triples_sql()}), one AS (SELECT source_type, target_type, min(relation) AS only_one FROM t GROUP BY ALL HAVING count(*) = 1),
turned AS (SELECT CASE WHEN relation IN ('after', 'caused_by') THEN target ELSE source END AS source,
  CASE WHEN relation IN ('before', 'after') THEN 'precedes' WHEN relation = 'caused_by' THEN 'causes' ELSE relation END AS relation,
  CASE WHEN relation IN ('after', 'caused_by') THEN source ELSE target END AS target, source_type, target_type FROM claims WHERE target IS NOT NULL)
SELECT source, coalesce(t.relation, only_one) AS relation, target FROM turned c LEFT JOIN t USING (source_type, relation, target_type) LEFT JOIN one USING (source_type, target_type)
WHERE coalesce(t.relation, only_one) IS NOT NULL""")
def repairable_relations(spark, d):
    orders = table(spark, d, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    event, person = F.lit("Event"), F.lit("Character")
    o, c = _id("o", "o_orderkey"), _id("c", "o_custkey")
    wrong = F.when(F.col("o_orderstatus") == "F", "after").when(F.col("o_orderstatus") == "O", "before").otherwise("caused_by")
    names = ["source", "relation", "target", "source_type", "target_type"]
    claims = (
        orders.select(o, wrong, F.concat(F.lit("o"), before.cast("string")), event, event).toDF(*names).filter("target is not null")
        .union(orders.select(o, F.lit("happens_on"), _id("d", "o_orderkey"), event, F.lit("TimePoint")))
        .union(orders.select(c, F.lit("performs"), o, person, event)).union(orders.select(c, F.lit("ordered"), o, person, event)))
    return graph.repair_relations(claims).select("source", "relation", "target")


@query(f"WITH {RAW_SQL} SELECT source, relation FROM raw WHERE source = target")
def self_loops(spark, d):
    return raw_edges(spark, d).filter("source = target").select("source", "relation")


ROLES_SQL = "roles AS (SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW')"


@query(f"WITH {ROLES_SQL} SELECT 'o' || o_orderkey AS id FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT target FROM roles)")
def uncovered_events(spark, d):
    orders = table(spark, d, "orders")
    roles = orders.filter("o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'").select(_id("c", "o_custkey").alias("source"), F.lit("performs").alias("relation"), _id("o", "o_orderkey").alias("target"))
    events = orders.select(_id("o", "o_orderkey").alias("id"), F.lit("Event").alias("type"))
    return graph.uncovered_events(events, roles).select("id")


@query(f"""WITH {ROLES_SQL}, bare AS (SELECT * FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT target FROM roles))
SELECT 'c' || c_custkey AS source, 'performs' AS relation, 'o' || o_orderkey AS target, 0.6::DOUBLE AS confidence, o_orderpriority AS evidence FROM bare JOIN customer ON c_custkey = o_custkey""")
def event_coverage_synth(spark, d):
    """A performs edge for each uncovered event, from its first participant that is a known character."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    bare = orders.join(uncovered_events(spark, d), _id("o", "o_orderkey") == F.col("id"), "left_semi").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_custkey", _id("o", "o_orderkey").alias("event_id"), F.array("c_mktsegment", F.concat(F.lit("Mr "), F.col("c_name"))).alias("participants"), F.array("o_orderpriority").alias("evidence"))
    who = customer.select(F.col("c_custkey").alias("o_custkey"), _id("c", "c_custkey").alias("entity_id"), F.lit(1).alias("pos"), F.lit("Character").alias("type"), F.col("c_name").alias("name"))
    place = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("entity_id"), F.lit(0).alias("pos"), F.lit("Concept").alias("type"), F.col("c_mktsegment").alias("name"))
    return extraction.cover_events(bare, who.unionByName(place), "o_custkey").select("source", "relation", "target", "confidence", F.array_join("evidence", "|").alias("evidence"))


@query("""WITH RECURSIVE e AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
n AS (SELECT a AS id FROM u UNION SELECT 'c' || c_custkey FROM customer),
w(id, root) AS (SELECT id, id FROM n UNION SELECT u.b, w.root FROM w JOIN u ON w.id = u.a) SELECT id, min(root) AS root FROM w GROUP BY id""")
def connected_components(spark, d):
    orders = table(spark, d, "orders")
    e = orders.select(_id("c", "o_custkey").alias("source"), _id("o", "o_orderkey").alias("target"))
    n = e.select(F.explode(F.array("source", "target")).alias("id")).union(table(spark, d, "customer").select(_id("c", "c_custkey"))).distinct()
    return graph.components(n, e)


@query("""WITH s AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS scene FROM orders)
SELECT scene, count(DISTINCT 'o' || o_orderkey) + count(DISTINCT 'c' || o_custkey) AS nodes, count(*) AS edges FROM s GROUP BY scene""")
def scene_subgraph(spark, d):
    """Every scene's subgraph at once: nodes with the scene and the ends of its edges (a scene is a month)."""
    own = table(spark, d, "orders").select(_id("c", "o_custkey").alias("source"), _id("o", "o_orderkey").alias("target"), F.array(F.date_format("o_orderdate", "yyyy-MM")).alias("scene_refs"))
    ids, edges_ = graph.scene_subgraphs(own.select(F.col("target").alias("id"), "scene_refs"), own)
    return ids.groupBy("scene").agg(F.count("*").alias("nodes")).join(edges_.groupBy("scene").agg(F.count("*").alias("edges")), "scene")


@query("SELECT 'k' || l_orderkey AS raw_id, min('p' || l_partkey) AS canonical FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) = 1")
def ambiguous_ids(spark, d):
    raw = table(spark, d, "lineitem").select(_id("k", "l_orderkey").alias("raw_id"), _id("p", "l_partkey").alias("canonical"))
    return graph.resolve_ids(raw)


PARTS_SQL = "p AS (SELECT 'p' || p_partkey AS id, p_partkey AS pos, p_name AS name, p_type AS description, lower(array_to_string(regexp_extract_all(p_type, '[A-Za-z0-9]+'), ' ')) AS key FROM part)"


@query(f"""WITH {PARTS_SQL} SELECT key, arg_min(id, pos) AS id, arg_min(name, pos) AS name, array_to_string(list_sort(list_distinct(list(name))), '|') AS aliases,
arg_max(description, (length(description), -pos)) AS description, count(*) AS merged FROM p GROUP BY key""")
def exact_merge(spark, d):
    p = table(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), text.norm_resolution(F.col("p_type"), F.lit("Object")).alias("key"))
    return graph.merge_nodes(p).withColumn("aliases", F.array_join("aliases", "|"))


@query("SELECT count(*) AS raw, count(DISTINCT p_type) AS merged, round(1 - count(DISTINCT p_type)::DOUBLE / count(*), 3) AS duplicate_rate FROM part")
def merge_rate(spark, d):
    return table(spark, d, "part").agg(F.count("*").alias("raw"), F.count_distinct("p_type").alias("merged")).withColumn("duplicate_rate", F.round(1 - F.col("merged") / F.col("raw"), 3))


@query(f"""WITH {EDGES_SQL}, claimed AS (SELECT source, relation, target, list_distinct(flatten(list(evidence))) AS evidence, max(confidence) AS confidence FROM raw WHERE source <> target GROUP BY ALL),
wrong AS (SELECT c.* FROM claimed c JOIN nodes s ON c.source = s.id JOIN nodes t ON c.target = t.id ANTI JOIN triples v ON v.source_type = s.type AND v.relation = c.relation AND v.target_type = t.type)
SELECT 'nodes_by_type' AS metric, type AS key, count(*)::DOUBLE AS value FROM nodes GROUP BY type
UNION ALL SELECT 'edges_by_relation', relation, count(*)::DOUBLE FROM claimed GROUP BY relation
UNION ALL SELECT 'schema_violations', 'all', (SELECT count(*) FROM wrong)::DOUBLE
UNION ALL SELECT 'evidence_coverage', 'edges', round(100 * avg(CASE WHEN len(evidence) > 0 THEN 1.0 ELSE 0.0 END), 1) FROM claimed
UNION ALL SELECT 'avg_confidence', 'edges', round(avg(confidence), 3) FROM claimed
UNION ALL SELECT 'avg_degree', 'nodes', round(2.0 * (SELECT count(*) FROM claimed) / (SELECT count(*) FROM nodes), 2)""")
def graph_stats(spark, d):
    """Statistics of the graph as claimed, wrong edges included."""
    return graph.statistics(nodes(spark, d), graph.dedupe_edges(raw_edges(spark, d).filter("source <> target")))
