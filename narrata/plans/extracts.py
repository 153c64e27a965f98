"""Queries over extraction post-processing, bound to the star tables, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.functions import text
from narrata.operators import corpus, extraction, resolve

from .registry import query, table
from .texts import LINES_SQL, _in


def _join(col):
    return F.array_join(col, "|")


KEY = "array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+'), ' ')"


@query(f"""WITH f AS (SELECT p_partkey, p_name AS c, p_type AS e, unnest([p_name, p_type, p_brand, string_split(p_name, ' ')[1]]) AS f FROM part),
k AS (SELECT *, {KEY.format(c='c')} AS kc, {KEY.format(c='f')} AS kf, {KEY.format(c='e')} AS ke FROM f)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list(f))), '|') AS forms FROM k
WHERE kf <> '' AND (contains(kf, kc) OR contains(kc, kf) OR contains(ke, kf) OR list_has_all(string_split(ke, ' '), string_split(kf, ' '))) GROUP BY p_partkey""")
def surface_forms(spark, d):
    p = table(spark, d, "part")
    forms = F.array(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.element_at(F.split("p_name", " "), 1))
    return p.select("p_partkey", _join(F.array_sort(extraction.surface_forms(F.col("p_name"), forms, F.lit("Object"), F.array("p_type")))).alias("forms"))


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct([c_name, 'Captain ' || c_name, c_mktsegment || ' 7'])), '|') AS aliases FROM customer")
def alias_clean(spark, d):
    c = table(spark, d, "customer")
    aliases = F.array(F.lit("Captain"), F.lit("the voice"), F.concat(F.lit("Captain "), F.col("c_name")), F.lit("--"), F.concat(F.col("c_mktsegment"), F.lit(" 7")), F.col("c_name"))
    return c.select("c_custkey", _join(F.array_sort(extraction.clean_aliases(F.col("c_name"), aliases, F.lit("Character")))).alias("aliases"))


@query(r"""WITH e AS (SELECT conv_id, turn, trim(regexp_replace(unnest(string_split(text, '.')), '\s+', ' ', 'g')) AS e FROM conversations)
SELECT conv_id, turn, count(DISTINCT e) AS n, md5(string_agg(DISTINCT e, '|' ORDER BY e)) AS evidence FROM e WHERE e <> '' GROUP BY ALL""")
def evidence_norm(spark, d):
    e = extraction.clean_evidence(F.split("text", r"\."))
    return table(spark, d, "conversations").select("conv_id", "turn", e.alias("e")).filter("size(e) > 0").select("conv_id", "turn", F.size("e").cast("long").alias("n"), F.md5(_join(F.array_sort("e"))).alias("evidence"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS items FROM events")
def coerce_lists(spark, d):
    """Values that come as a scalar, a list with blanks, or objects, as one list of strings."""
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    raw = F.when(n == 0, k).when(n == 1, F.concat(F.lit('["'), k, F.lit('", " ", ""]'))).when(n == 2, F.concat(F.lit('[{"id": "x", "name": "'), k, F.lit('"}]'))).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    return table(spark, d, "events").select("event_id", _join(extraction.string_list(raw)).alias("items"))


@query("""WITH e AS (SELECT conv_id, turn, role || turn AS v FROM conversations WHERE turn % 2 = 0), w AS (SELECT conv_id, string_agg(v, '|' ORDER BY v) AS v FROM e GROUP BY conv_id)
SELECT c.conv_id, c.turn, coalesce(e.v, w.v, '') AS found FROM conversations c LEFT JOIN e USING (conv_id, turn) LEFT JOIN w USING (conv_id)""")
def chunk_fallback(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("v"))
    return extraction.with_fallback(c.select("conv_id", "turn"), ["conv_id", "turn"], ["conv_id"], c.filter("turn % 2 = 0"), "v").withColumn("found", _join("found"))


@query("SELECT o_custkey, o_orderkey AS event_id, 'c' || c_custkey AS entity_id FROM orders JOIN customer ON o_custkey = c_custkey")
def first_participants(spark, d):
    """Orders whose participants are a segment and a customer's name; only the customer may act."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    events = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", F.col("o_orderkey").alias("event_id"), F.array("c_mktsegment", F.concat(F.lit("Mr "), F.col("c_name"))).alias("participants"))
    who = c.select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit(1).alias("pos"), F.lit("Character").alias("type"), F.col("c_name").alias("name"))
    other = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("entity_id"), F.lit(0).alias("pos"), F.lit("Concept").alias("type"), F.col("c_mktsegment").alias("name"))
    return extraction.first_participants(events, who.unionByName(other), "o_custkey")


@query("SELECT o_orderkey, (o_orderstatus = 'P' OR o_orderkey % 2 = 0 OR o_orderpriority = '2-HIGH') AS sane FROM orders")
def role_sanity(spark, d):
    o = table(spark, d, "orders")
    event = F.col("o_orderkey").cast("string")
    linked = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).when(F.col("o_orderkey") % 2 == 0, F.array(event, F.lit("x"))).otherwise(F.array(F.lit("x")))
    who = F.array(F.when(F.col("o_orderpriority") == "2-HIGH", "Dr Ada Byron").otherwise("Bob"))
    return o.select("o_orderkey", extraction.role_sane(F.lit("performs"), event, linked, who, F.lit("Ada Byron")).alias("sane"))


@query("""WITH n AS (SELECT 'p' || p_partkey AS id, 't' || (p_partkey % 100) AS temp, p_name AS name, p_partkey AS pos FROM part), k AS (SELECT id AS key, name, pos FROM n UNION ALL SELECT temp, name, pos FROM n),
u AS (SELECT key, arg_max(name, pos) AS name FROM k GROUP BY key)
SELECT l_orderkey, l_linenumber, a.name AS source_name, b.name AS target_name FROM lineitem LEFT JOIN u a ON a.key = 'p' || l_partkey LEFT JOIN u b ON b.key = 't' || (l_suppkey % 150)""")
def stamp_names(spark, d):
    n = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("t"), (F.col("p_partkey") % 100).cast("string")).alias("temp_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_id"), F.concat(F.lit("t"), (F.col("l_suppkey") % 150).cast("string")).alias("target_id"))
    return extraction.stamp_names(r, n).select("l_orderkey", "l_linenumber", "source_name", "target_name")


@query(f"""WITH {LINES_SQL}, o AS (SELECT doc_id, (doc_id * 37) % (length(text) + 20) AS off FROM documents),
h AS (SELECT o.doc_id, o.off, s.scene_no FROM o JOIN spans s ON s.doc_id = o.doc_id AND s.char_start <= o.off AND o.off < s.char_end), m AS (SELECT doc_id, max(scene_no) AS last FROM spans GROUP BY doc_id)
SELECT o.doc_id, o.off::BIGINT AS off, coalesce(h.scene_no, m.last)::INT AS scene_no FROM o JOIN m USING (doc_id) LEFT JOIN h USING (doc_id)""")
def offset_scene(spark, d):
    docs = table(spark, d, "documents")
    offsets = docs.select("doc_id", ((F.col("doc_id") * 37) % (F.length("text") + 20)).alias("off"))
    scenes = corpus.line_scenes(docs, "doc_id", "text").select("doc_id", "char_start", "char_end", "scene_no")
    return extraction.scene_at(offsets, scenes, "doc_id", "off").select("doc_id", "off", "scene_no")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r(user_id, i, event_id, day, event_type, days, types, kept) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, '', '', []::VARCHAR[], []::VARCHAR[], false FROM e
  UNION ALL SELECT e.user_id, e.i, e.event_id, e.day, e.event_type, CASE WHEN list_contains(days, e.day) OR list_contains(types, e.event_type) THEN days ELSE list_append(days, e.day) END,
    CASE WHEN list_contains(days, e.day) OR list_contains(types, e.event_type) THEN types ELSE list_append(types, e.event_type) END, NOT (list_contains(days, e.day) OR list_contains(types, e.event_type))
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, day, event_type FROM r WHERE kept""")
def kept_first(spark, d):
    """Events kept in order while neither their day nor their type was taken by a kept one."""
    e = table(spark, d, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return extraction.first_kept(e, "user_id", "event_id", ["day", "event_type"])


@query(f"""WITH n AS (SELECT c_nationkey AS story_id, 'c' || c_custkey AS id, c_custkey AS pos, c_name AS name FROM customer),
k AS (SELECT *, array_to_string(list_filter({KEY.format(c='name').replace("array_to_string(", "").replace(", ' ')", "")}, lambda x: x NOT IN ({_in(text.TITLES)})), ' ') AS key FROM n)
SELECT story_id, key, arg_min(id, pos) AS id, count(*) AS merged FROM k GROUP BY ALL""")
def resolve_exact(spark, d):
    """Characters of a nation merged by their resolution key."""
    n = table(spark, d, "customer").select(F.col("c_nationkey").alias("story_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.lit("Character").alias("type"))
    return resolve.exact_key(n).groupBy("story_id", "key").agg(F.min_by("id", "pos").alias("id"), F.count("*").alias("merged"))


@query("""WITH n AS (SELECT c_nationkey AS nation, 'Ada' || (c_custkey % 50) AS head, c_custkey AS k, c_custkey % 3 = 0 AS short FROM customer),
f AS (SELECT nation, head, min(k) FILTER (NOT short) AS first, max(k) FILTER (NOT short) AS last FROM n GROUP BY ALL)
SELECT nation::VARCHAR AS story_id, 'c' || k AS id, 'c' || CASE WHEN k < first THEN last ELSE first END AS merged_into FROM n JOIN f USING (nation, head) WHERE short AND first IS NOT NULL""")
def prefix_merge(spark, d):
    """Characters of one token, and of two with a last one of their own, per nation: the short ones go into fuller ones.

    What comes before all fuller names goes into the last of them, as its turn
    meets them all; what comes after the first of them goes into that one.
    """
    c = table(spark, d, "customer")
    base = F.concat(F.lit("Ada"), (F.col("c_custkey") % 50).cast("string"))
    name = F.when(F.col("c_custkey") % 3 == 0, base).otherwise(F.concat(base, F.lit(" c"), F.col("c_custkey").cast("string")))
    n = c.select(F.col("c_nationkey").cast("string").alias("story_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("pos"), name.alias("name"), F.lit("Character").alias("type"))
    return resolve.merge_prefixes(n).withColumnRenamed("into", "merged_into")


@query()
def insertion_validation(spark, d):
    """Documents as stories, lines as scenes: an edit of the third line against the first, with its failing checks."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("story_id"), "text")
    lines = F.split("text", "\n")
    item = F.struct(F.lit(1).alias("id"), F.concat(F.lit("entity "), F.col("story_id")).alias("anchor_entity"), F.lit(1).alias("anchor_scene"), F.get(lines, F.lit(0)).alias("anchor_quote"),
                    F.lit(3).alias("violation_scene"), F.coalesce(F.get(lines, F.lit(2)), F.lit("")).alias("violation_quote_original"), F.concat(F.lit("Never "), F.coalesce(F.get(lines, F.lit(2)), F.lit(""))).alias("violation_quote_edited"), F.lit(1).alias("words_changed"))
    return corpus.validate_stories(docs.withColumn("insertions", F.array(item)))


@query("SELECT conv_id, count(*)::INT AS scenes, least(floor(count(*) * 0.6 + 0.5)::INT, 8, count(*)::INT - 1) AS target FROM conversations GROUP BY conv_id")
def insertion_targets(spark, d):
    """The builder's target (half up) for short stories."""
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("scenes"))
    return n.withColumn("target", corpus.target_insertions(F.col("scenes"), F.lit("5k"), half_up=True))


@query(f"SELECT conv_id, turn, (turn > (count(*) OVER (PARTITION BY conv_id)) / 2 AND NOT regexp_matches(lower(text), '{'|'.join(corpus.MOTIVES)}')) AS distance_only FROM conversations")
def hard_by_distance(spark, d):
    total = F.count("*").over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", corpus.distance_only_hard(F.lit("hard"), F.col("turn"), total, F.col("text")).alias("distance_only"))
