"""Queries over time: conversations as stories, a user's days as scenes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.functions import text
from narrata.operators import extraction, facts, verify

from .registry import query, table
from .texts import _in

ATTRS_SQL = """attrs AS (SELECT user_id AS story_id, event_type AS entity, 'k' AS attr, (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::INT AS scene_no,
  arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS value FROM events GROUP BY ALL)"""


def attributes(spark, d):
    """A user's last value per event type and day: story_id, entity, attr, scene_no, value."""
    scene = (F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("scene_no")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("story_id"), F.col("event_type").alias("entity"), F.lit("k").alias("attr"), scene).agg(
        F.max_by(F.get_json_object("props", "$.k"), F.struct("ts", "event_id")).alias("value"))


def scenes(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("story_id"), (F.col("turn") + 1).cast("int").alias("scene_no"), "role", "text")


@query("""SELECT b.conv_id AS story_id, (b.turn + 1)::INT AS scene_no, (a.turn + 1)::INT AS prior_scene_no, a.role AS prior_role FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def prior_scene_pairs(spark, d):
    s = scenes(spark, d).select("story_id", "scene_no", "role")
    return facts.prior_pairs(s.select("story_id", "scene_no"), s).select("story_id", "scene_no", "prior_scene_no", "prior_role")


@query("""SELECT conv_id AS story_id, (turn + 1)::INT AS scene_no, (count(*) OVER w)::INT AS n_prior, md5(coalesce(string_agg(text, chr(10)) OVER w, '')) AS prior
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_accumulate(spark, d):
    return facts.accumulate(scenes(spark, d), "text").select("story_id", "scene_no", F.size("prior").alias("n_prior"), F.md5(F.array_join("prior", "\n")).alias("prior"))


CHANGES_SQL = ATTRS_SQL + """, lagged AS (SELECT *, lag(value) OVER w AS previous, lag(scene_no) OVER w AS previous_scene FROM attrs WINDOW w AS (PARTITION BY story_id, entity, attr ORDER BY scene_no)),
changes AS (SELECT *, scene_no - previous_scene AS distance FROM lagged WHERE previous <> value)"""


@query(f"WITH {CHANGES_SQL} SELECT story_id, entity, scene_no, value, previous, previous_scene, distance FROM changes")
def value_changes(spark, d):
    return facts.value_changes(attributes(spark, d)).select("story_id", "entity", "scene_no", "value", "previous", "previous_scene", "distance")


@query(f"""WITH {ATTRS_SQL}, s AS (SELECT story_id, entity, scene_no, string_agg(attr || '=' || value, ', ' ORDER BY attr) AS kv FROM attrs GROUP BY ALL)
SELECT story_id, entity, string_agg('S' || scene_no || ': ' || kv, ' | ' ORDER BY scene_no) AS history FROM s GROUP BY ALL""")
def attr_history_text(spark, d):
    return facts.history(attributes(spark, d))


#: A story's event types as nodes (views are places) and edges between them; only what has a number lasts.
KINDS_SQL = """kinds AS (SELECT user_id AS story_id, event_type AS id, (row_number() OVER (PARTITION BY user_id ORDER BY event_type))::INT AS pos, CASE WHEN event_type = 'view' THEN 'Location' ELSE 'Concept' END AS type,
  CASE WHEN count(*) % 2 = 0 THEN event_type || ' ' || count(*) ELSE event_type END AS name, CASE WHEN count(*) % 3 = 0 THEN 'three of a week' END AS description FROM events GROUP BY user_id, event_type),
links AS (SELECT a.story_id, (100 * a.pos + b.pos)::INT AS pos, CASE WHEN a.pos % 2 = 0 THEN 'part_of' ELSE 'located_at' END AS relation, a.name AS s, b.name AS t FROM kinds a JOIN kinds b ON a.story_id = b.story_id AND a.pos < b.pos)"""


def _kinds(spark, d):
    n = F.count("*")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("story_id"), F.col("event_type").alias("id")).agg(n.alias("n"))
    w = Window.partitionBy("story_id").orderBy("id")
    nodes = e.select("story_id", F.lit(1).alias("scene_no"), F.row_number().over(w).alias("pos"), "id", F.when(F.col("id") == "view", "Location").otherwise("Concept").alias("type"),
                     F.when(F.col("n") % 2 == 0, F.concat_ws(" ", "id", "n")).otherwise(F.col("id")).alias("name"), F.when(F.col("n") % 3 == 0, "three of a week").alias("description"))
    a, b = (nodes.select("story_id", F.col("id").alias(c), F.col("pos").alias(f"{c}_pos")) for c in ("source", "target"))
    edges = a.join(b, "story_id").filter("source_pos < target_pos").select("story_id", F.lit(1).alias("scene_no"), (100 * F.col("source_pos") + F.col("target_pos")).alias("pos"), "source",
                                                                          F.when(F.col("source_pos") % 2 == 0, "part_of").otherwise("located_at").alias("relation"), "target")
    return nodes, edges


_DURABLE = "regexp_matches(lower({t}), '(^|[^\\p{{L}}\\p{{N}}_])[0-9]+($|[^\\p{{L}}\\p{{N}}_])') OR list_has_any(regexp_extract_all(lower({t}), '[a-z0-9]+'), [" + _in(text.DURABLE_TERMS) + "])"
NODE_TEXT_SQL = "name || CASE WHEN description IS NULL THEN '' ELSE ' — ' || description END"


@query(f"""WITH {ATTRS_SQL}, {KINDS_SQL}, nt AS (SELECT *, {NODE_TEXT_SQL} AS text FROM kinds), lt AS (SELECT *, '(' || s || ') -[' || relation || ']-> (' || t || ')' AS text FROM links),
n AS (SELECT story_id, 0 AS class, (row_number() OVER (PARTITION BY story_id ORDER BY scene_no, entity))::INT AS pos, 'attribute' AS kind, entity || '.' || attr || ' = ' || value AS text, entity AS name FROM attrs
  UNION ALL SELECT story_id, 1, pos, lower(type), text, name FROM nt WHERE type <> 'Location' AND ({_DURABLE.format(t='text')})
  UNION ALL SELECT story_id, 2, pos, 'relation', text, text FROM lt WHERE relation <> 'located_at' AND ({_DURABLE.format(t='text')})),
u AS (SELECT story_id, text, arg_min({{'c': class, 'p': pos, 'k': kind, 'n': name}}, (class, pos)) AS f FROM n GROUP BY ALL),
r AS (SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY f.c, f.p, text)::INT AS pos, f.k AS kind, text, f.n AS name FROM u) SELECT * FROM r WHERE pos <= 25""")
def top25_facts(spark, d):
    """A story's first 25 facts, its days taken as one scene (the budget of a verifier's prompt)."""
    pos = F.row_number().over(Window.partitionBy("story_id").orderBy("scene_no", "entity"))
    a = attributes(spark, d).withColumn("pos", pos).withColumn("scene_no", F.lit(1))
    n, e = _kinds(spark, d)
    return facts.candidate_facts(n, e, a).select("story_id", "pos", "kind", "text", "name")


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY ALL")
def first_wins(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return extraction.first_wins(e, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("user_id", "event_type", "day", "event_id")


@query("SELECT event_id, (row_number() OVER w)::INT AS index, ((row_number() OVER w - 1) // 12 + 1)::INT AS batch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def batch_numbers(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", n.alias("index"), (F.floor((n - 1) / 12) + 1).cast("int").alias("batch"))


@query(f"WITH {CHANGES_SQL} SELECT entity, count(*) AS n, round(avg(distance), 2) AS mean_distance, max(distance) AS most, bool_or(distance > 5) AS any_far FROM changes GROUP BY entity")
def scene_distance(spark, d):
    return facts.value_changes(attributes(spark, d)).groupBy("entity").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 2).alias("mean_distance"), F.max("distance").alias("most"), F.bool_or(F.col("distance") > 5).alias("any_far"))


@query(r"""WITH c AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior, text FROM conversations),
q AS (SELECT conv_id, turn, string_split(prior, '.')[1] AS quote, text FROM c WHERE prior IS NOT NULL),
t AS (SELECT *, regexp_extract_all(lower(quote), '[a-z0-9]+') AS qt, regexp_extract_all(lower(text), '[a-z0-9]+') AS st FROM q),
w AS (SELECT *, greatest(len(qt), 4) AS win FROM t)
SELECT conv_id, turn, CASE WHEN quote = '' OR text = '' THEN false WHEN contains(lower(text), lower(quote)) THEN true WHEN len(qt) < 3 OR len(st) = 0 THEN false
ELSE len(list_filter(range(1, greatest(1, len(st) - win + 1) + 1), lambda i: len(list_intersect(list_distinct(qt), list_distinct(st[i : i + win - 1])))
  >= 0.30::DOUBLE * len(list_distinct(list_concat(qt, st[i : i + win - 1]))))) > 0 END AS grounded FROM w""")
def quote_grounding(spark, d):
    """Is a turn's first sentence quoted, in words or nearly, in the next turn?"""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("prior", F.lag("text").over(w)).filter("prior is not null")
    return c.select("conv_id", "turn", verify.grounded(F.element_at(F.split("prior", r"\."), 1), F.col("text")).alias("grounded"))


PAIRS_SQL = r"""turns AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations),
toks AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(prior), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM turns WHERE prior IS NOT NULL),
j AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS i FROM toks)"""


def _pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("prior", F.lag("text").over(w)).filter("prior is not null")
    return c.select("conv_id", "turn", F.array_distinct(text.ascii_tokens(F.col("prior"))).alias("a"), F.array_distinct(text.ascii_tokens(F.col("text"))).alias("b"))


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, round(CASE WHEN na + nb - i = 0 THEN 1.0 ELSE i / (na + nb - i) END, 6) AS jaccard FROM j")
def jaccard_pairs(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, round(CASE WHEN na + nb = 0 THEN 1.0 WHEN least(na, nb) = 0 THEN 0.0 ELSE greatest(i / (na + nb - i), i / least(na, nb)) END, 6) AS overlap FROM j")
def soft_overlap(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(text.soft_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(f"""WITH t AS (SELECT conv_id AS story_id, (turn + 1)::INT AS scene_no, lower(role) AS tag, text, {_DURABLE.format(t='text')} AS durable, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
l AS (SELECT story_id, scene_no, '[' || CASE WHEN tag = 'user' THEN 'event' ELSE 'concept' END || '] ' || text AS line FROM t WHERE tag = 'user' OR durable
  UNION ALL SELECT story_id, scene_no, '(' || text || ') -[causes]-> (' || story_id || '-' || (scene_no + 1) || ')' FROM t WHERE reply IS NOT NULL AND scene_no % 2 = 1
  UNION ALL SELECT story_id, scene_no, '[attr] ' || tag || '.length = ' || length(text) FROM t)
SELECT story_id, scene_no, md5('S' || scene_no || ': ' || line) AS line FROM l""")
def prior_summary(spark, d):
    """Lines that a scene contributes to the summary of what was before: all events, other nodes only if durable, lasting relations, attributes."""
    kind = F.when(F.lower("role") == "user", "Event").otherwise("Concept")
    s, key = scenes(spark, d), lambda by: F.concat_ws("-", "story_id", F.col("scene_no") + by)
    n = s.select("story_id", "scene_no", F.lit(1).alias("pos"), key(0).alias("id"), kind.alias("type"), F.col("text").alias("name"), F.lit(None).cast("string").alias("description"))
    more = F.lead("text").over(Window.partitionBy("story_id").orderBy("scene_no"))
    e = s.withColumn("reply", more).filter("reply is not null").select(
        "story_id", "scene_no", F.lit(1).alias("pos"), key(0).alias("source"), F.when(F.col("scene_no") % 2 == 1, "causes").otherwise("located_at").alias("relation"), key(1).alias("target"))
    a = s.select("story_id", "scene_no", F.lit(1).alias("pos"), F.lower("role").alias("entity"), F.lit("length").alias("attr"), F.length("text").cast("string").alias("value"))
    return facts.prior_summary(n, e, a).select("story_id", "scene_no", F.explode("lines").alias("line")).withColumn("line", F.md5("line"))


FIND_SQL = CHANGES_SQL + """, findings AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY scene_no, entity)::INT AS pos, entity || ' k was ' || previous AS fact, entity || ' k is ' || value AS event FROM changes)"""


def findings(spark, d):
    """A finding per value change: story_id, pos, x, fact, y, event."""
    c = facts.value_changes(attributes(spark, d))
    pos = F.row_number().over(Window.partitionBy("story_id").orderBy("scene_no", "entity"))
    return c.select("story_id", pos.alias("pos"), F.col("previous_scene").alias("x"), F.concat(F.col("entity"), F.lit(" k was "), F.col("previous")).alias("fact"),
                    F.col("scene_no").alias("y"), F.concat(F.col("entity"), F.lit(" k is "), F.col("value")).alias("event"))


@query(f"WITH {FIND_SQL} SELECT story_id, pos, 'In scene ' || previous_scene || ', ' || fact || ' was established, yet in scene ' || scene_no || ', ' || event || ' happens' AS text FROM findings")
def template_render(spark, d):
    return findings(spark, d).select("story_id", "pos", text.render_finding(F.col("x"), F.col("fact"), F.col("y"), F.col("event")).alias("text"))


@query(f"WITH {FIND_SQL} SELECT story_id, pos, previous_scene AS x, fact, scene_no AS y, event FROM findings WHERE pos % 5 <> 4")
def template_parse(spark, d):
    """Strict sentences, sentences without 'happens', without 'was established', without both; and prose, which gives no row."""
    f = findings(spark, d)
    full = text.render_finding(F.col("x"), F.col("fact"), F.col("y"), F.col("event"))
    n = F.col("pos") % 5
    s = F.when(n == 1, F.regexp_replace(full, " happens$", ".")).when(n == 2, F.replace(full, F.lit(" was established"), F.lit(""))).when(
        n == 3, F.regexp_replace(F.replace(full, F.lit(" was established"), F.lit("")), " happens$", "")).when(n == 4, F.lit("Nothing of note.")).otherwise(full)
    return f.select("story_id", "pos", text.parse_finding(s).alias("p")).filter("p is not null").select("story_id", "pos", "p.x", "p.fact", "p.y", "p.event")
