"""Post-processing of extracted events, entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import text

#: Types whose surface forms must be near the canonical name or stand in the evidence.
STRICT_FORMS = ("Location", "Object", "Concept", "Vehicle")
ROLES = ("performs", "undergoes", "experiences")


def string_list(col: Column) -> Column:
    """JSON text as a list of clean strings: scalars alone, objects by their first non-empty of text, name, canonical_name, id, scene_id, else as JSON."""
    items = F.coalesce(F.from_json(col, "array<string>"), F.array(F.coalesce(F.when(~F.trim(col).rlike(r'^[\[{"]'), col), F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit("}")), "$.v"), col)))

    def plain(x: Column) -> Column:
        named = [F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("text", "name", "canonical_name", "id", "scene_id")]
        return F.trim(F.coalesce(F.when(x.startswith("{"), F.coalesce(*named)), x))

    return F.filter(F.transform(items, plain), lambda x: x.isNotNull() & (x != ""))


def clean_evidence(evidence: Column) -> Column:
    """Trimmed, white space squeezed, empty ones dropped, the first of equals kept."""
    return F.array_distinct(F.filter(F.transform(evidence, text.squeeze), lambda x: x != ""))


def supported(form: Column, evidence: Column) -> Column:
    """A form stands in some evidence: as a substring of its key, or with all its tokens."""
    key = text.norm_text(form)
    tokens = F.split(key, " ")
    return (key != "") & F.exists(evidence, lambda e: text.norm_text(e).contains(key) | (F.size(F.array_except(tokens, F.split(text.norm_text(e), " "))) == 0))


def surface_forms(canonical: Column, forms: Column, node_type: Column, evidence: Column) -> Column:
    """The canonical name, then its distinct forms; for strict types only forms near it or supported."""
    key = text.norm_text(canonical)

    def near(f: Column) -> Column:
        k = text.norm_text(f)
        return (k != "") & ((k == key) | k.contains(key) | key.contains(k))

    ordered = F.array_distinct(F.filter(F.concat(F.array(canonical), forms), lambda f: F.trim(f) != ""))
    kept = F.filter(ordered, lambda f: near(f) | supported(f, evidence))
    out = F.when(node_type.isin(*STRICT_FORMS), kept).otherwise(ordered)
    return F.when(F.size(out) == 0, F.array(canonical)).otherwise(out)


def clean_aliases(canonical: Column, aliases: Column, node_type: Column) -> Column:
    """The canonical name, then distinct aliases; a character's generic or empty ones go unless their key is the canonical one."""
    key = text.norm_graph(canonical, node_type)
    ordered = F.array_distinct(F.concat(F.array(canonical), aliases))
    kept = F.filter(ordered, lambda a: (a == canonical) | (text.norm_graph(a, node_type) == key) | (~text.generic_alias(a) & (text.norm_graph(a, node_type) != "")))
    return F.when(node_type == "Character", kept).otherwise(ordered)


def tokens_within(a: Column, b: Column) -> Column:
    """The tokens of either name are all in the other; an empty name matches nothing."""
    x, y = text.ascii_tokens(text.fold(a)), text.ascii_tokens(text.fold(b))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def with_fallback(chunk: DataFrame, keys: list[str], scene: list[str], rows: DataFrame, value: str) -> DataFrame:
    """Each chunk with its rows' values as a sorted list; a chunk without any gets its scene's."""
    own = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("own"))
    whole = rows.groupBy(*scene).agg(F.array_sort(F.collect_set(value)).alias("whole"))
    return chunk.join(own, keys, "left").join(whole, scene, "left").withColumn("found", F.coalesce("own", "whole", F.array().cast("array<string>"))).drop("own", "whole")


def first_participants(events: DataFrame, entities: DataFrame, by: str) -> DataFrame:
    """(by, event_id, entity_id): the first participant that names an entity, and the first such entity.

    ``events``: by, event_id, participants; ``entities``: by, entity_id, pos,
    type, name.  Only characters, objects and vehicles act.  Names are compared
    within ``by`` (a chunk or scene), which bounds the pairs.
    """
    who = entities.filter(F.col("type").isin("Character", "Object", "Vehicle")).select(by, "entity_id", F.col("pos").alias("e_pos"), "name")
    named = events.select(by, "event_id", F.posexplode("participants").alias("p_pos", "participant")).join(who, by).filter(tokens_within(F.col("participant"), F.col("name")))
    w = Window.partitionBy(by, "event_id").orderBy("p_pos", "e_pos")
    return named.withColumn("r", F.row_number().over(w)).filter("r = 1").select(by, "event_id", "entity_id")


def cover_events(bare: DataFrame, entities: DataFrame, by: str, confidence: float = 0.6) -> DataFrame:
    """(by, source, relation, target, evidence, confidence): a performs edge for each event of ``bare``(by, event_id, participants, evidence) from its first known participant."""
    found = first_participants(bare, entities, by)
    return found.join(bare.select(by, "event_id", "evidence"), [by, "event_id"]).select(
        by, F.col("entity_id").alias("source"), F.lit("performs").alias("relation"), F.col("event_id").alias("target"), "evidence", F.lit(confidence).alias("confidence"))


def role_sane(relation: Column, event_id: Column, linked: Column, participants: Column, name: Column) -> Column:
    """A role edge whose entity names linked events needs this event among them or itself among the participants; others pass."""
    tied = F.array_contains(linked, event_id) | F.exists(participants, lambda p: tokens_within(p, name))
    return ~relation.isin(*ROLES) | (F.size(F.coalesce(linked, F.array().cast("array<string>"))) == 0) | tied


def stamp_names(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds source_name and target_name by id or temp_id; where a key names two nodes the later one counts."""
    keys = nodes.select(F.explode(F.array_distinct(F.array("id", "temp_id"))).alias("key"), "name", "pos").groupBy("key").agg(F.max_by("name", "pos").alias("name"))
    out = relations
    for end in ("source", "target"):
        out = out.join(keys.select(F.col("key").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left")
    return out


def scene_at(offsets: DataFrame, scenes: DataFrame, story: str, offset: str) -> DataFrame:
    """Adds the scene whose [char_start, char_end) holds an offset; past the end the last scene.

    The scenes of a story come as one sorted array, so nothing is paired.
    """
    packed = scenes.groupBy(story).agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "scene_no"))).alias("__scenes"))
    hit = F.get(F.filter("__scenes", lambda x: (x["char_start"] <= F.col(offset)) & (F.col(offset) < x["char_end"])), F.lit(0))
    return offsets.join(packed, story).withColumn("scene_no", F.coalesce(hit["scene_no"], F.element_at("__scenes", -1)["scene_no"])).drop("__scenes")


def first_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; every row reserves its key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def first_kept(rows: DataFrame, story: str, order: str, keys: list[str]) -> DataFrame:
    """Rows kept in order if none of their keys was taken by a kept row; a dropped row reserves nothing (a fold per story)."""
    item = F.struct(order, *keys)
    packed = rows.groupBy(story).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.filter("items", lambda x: F.lit(False))

    def step(kept, x):
        clash = F.exists(kept, lambda k: F.lit(False) if not keys else _any_equal(k, x, keys))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return packed.select(story, F.explode(F.aggregate("items", empty, step)).alias("k")).select(story, "k.*")


def _any_equal(a: Column, b: Column, keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | (a[k] == b[k])
    return out
