"""The whole lifecycle over all stories at once: extract, resolve, assemble, find contradictions, verify, score.

The remote steps are Arrow maps over chunks, scenes or batches, behind the
cache's anti-join; everything else is set-based and keyed by story and scene.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata import schema
from narrata.functions import jsonfix, text
from narrata.operators import corpus, extraction, facts, graph, resolve, score, verify
from narrata.shipping import cut

from .providers import Failures, Provider, answer

BATCH = 12


SENTENCE = re.compile(r"In\s+scene\s+\d+\s*,\s*.+?\s+was\s+established\s*,\s*yet\s+in\s+scene\s+\d+\s*,\s*.+?\s+happens\.?", re.I | re.S)


def findings_in(raw: str | None) -> list[dict]:
    """Template sentences in prose, white space squeezed: what a judge's answer is worth if it is not JSON."""
    return [{"hallucination": " ".join(m.group().split())} for m in SENTENCE.finditer(raw or "")]


class _Judge(Provider):
    """A provider whose answers are always JSON lists of findings."""

    def __init__(self, inner: Provider):
        self.inner, self.model_id = inner, inner.model_id

    def complete(self, prompt, system="", temperature=0.0, max_tokens=12288):
        raw = self.inner.complete(prompt, system, temperature, max_tokens)
        value = jsonfix.parse(raw)
        value = [value] if isinstance(value, dict) else value
        return json.dumps(value if isinstance(value, list) and value else findings_in(raw))


def not_held(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key the cache does not hold."""
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def ask(rows: DataFrame, stage: str, provider: Provider, hint: str = "", cache: DataFrame | None = None) -> DataFrame:
    """Adds ``answer`` (JSON or null) to (story_id, scene_no, chunk_id, body): cached answers first, blank bodies never asked."""
    keyed = rows.filter(F.col("body").rlike(r"\S")).withColumn("cache_key", text.cache_key(F.lit(stage), F.lit(provider.model_id), F.col("body")))
    todo = keyed if cache is None else not_held(keyed, cache)

    def run(batches):
        failures = Failures()
        for batch in batches:
            out = [None if (v := answer(provider, stage, b, hint, failures)) is None else json.dumps(v) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "answer"])

    types = ", ".join(f"{n} {t}" for n, t in keyed.dtypes)
    asked = cut(todo.select(*keyed.columns).mapInArrow(run, types + ", answer string"))  # a request is sent once
    if cache is None:
        return asked
    return asked.unionByName(keyed.join(cache.select("cache_key", "answer"), "cache_key").select(*asked.columns))


def contents(scenes: DataFrame) -> DataFrame:
    """(story_id, scene_no, chunk, content): the chunks that scenes come with, which extraction then reads."""
    return scenes.select("story_id", "scene_no", F.explode("chunks").alias("c")).select("story_id", "scene_no", F.col("c.id").alias("chunk"), F.col("c.content").alias("content"))


def chunks_of(scenes: DataFrame) -> DataFrame:
    """(story_id, scene_no, chunk_id, body) of scenes(story_id, scene_no, content), or of their ``chunk``s, cut where one is too long."""
    base = scenes if "chunk" in scenes.columns else scenes.withColumn("chunk", F.concat_ws("_", F.lit("chunk"), F.col("scene_no").cast("string")))
    cut = corpus.chunk_windows(base, "content", "chunk")
    return cut.select("story_id", "scene_no", F.col("window_id").alias("chunk_id"), F.col("window").alias("body"))


EVENT = "array<struct<temp_id: string, name: string, description: string, evidence: array<string>, participants: array<string>>>"
ENTITY = "array<struct<temp_id: string, type: string, canonical_name: string, surface_forms: array<string>, description: string, evidence: array<string>, linked_events: array<string>>>"
RELATION = "array<struct<source_id: string, relation: string, target_id: string, evidence: array<string>, confidence: double>>"
KEYS = ["story_id", "scene_no", "chunk_id"]
#: Items that a request shows, at most: events to the entity step, events and entities to the relation step (a feature of the prompts).
SHOWN = {"entities": 20, "events": 40, "relations": 60}
#: Confidence of an edge that is made for an event nobody takes part in by the relations found.
COVERED = 0.6


def _rows(answers: DataFrame, kind: str) -> DataFrame:
    return answers.select(*KEYS, F.posexplode(F.from_json("answer", kind)).alias("pos", "x")).select(*KEYS, "pos", "x.*")


def _shown(chunks: DataFrame, found: DataFrame, head: str, most: int, name: str) -> DataFrame:
    """Chunks whose bodies end with what was found in them, or else in their scene: at most ``most`` lines of id and name."""
    line = F.struct("pos", F.concat_ws("\t", "temp_id", name).alias("line"))
    own = found.groupBy(*KEYS).agg(F.array_sort(F.collect_list(line)).alias("own"))
    whole = found.groupBy("story_id", "scene_no").agg(F.array_sort(F.collect_list(line)).alias("whole"))
    rows = chunks.join(own, KEYS, "left").join(whole, ["story_id", "scene_no"], "left")
    lines = F.transform(F.slice(F.coalesce("own", "whole", F.expr("array()")), 1, most), lambda x: x["line"])
    return rows.withColumn("body", F.when(F.size(lines) > 0, F.concat_ws("\n", "body", F.lit(f"\n{head}:"), F.array_join(lines, "\n"))).otherwise(F.col("body"))).drop("own", "whole")


def extract(scenes: DataFrame, provider: Provider, cache: DataFrame | None = None, show: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw events, entities and relations of all chunks.

    With ``show``, the request for entities lists the events found, and that for
    relations both: the anchors that a language model needs.
    """
    chunks = chunks_of(scenes)
    events = _rows(ask(chunks, "events", provider, "event_list", cache), EVENT)
    about = _shown(chunks, events, "EVENTS", SHOWN["entities"], "name") if show else chunks
    entities = _rows(ask(about, "entities", provider, "entity_list", cache), ENTITY).filter(F.col("type").isin(*schema.ENTITY_TYPES))
    both = _shown(_shown(chunks, events, "EVENTS", SHOWN["events"], "name"), entities, "ENTITIES", SHOWN["relations"], "canonical_name") if show else chunks
    relations = _rows(ask(both, "relations", provider, "relation_list", cache), RELATION)
    return events, entities, relations


def _key(*columns) -> "F.Column":
    return F.concat_ws("|", *columns)


def assemble(events: DataFrame, entities: DataFrame, relations: DataFrame, renames: DataFrame | None = None, provider: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges per (story_id, scene_no).

    Nodes: aliases cleaned; resolved by renames(story_id, src, dst), exact keys,
    name prefixes and the provider's clusters, unless no provider is given; then
    merged by type and name key.  Edges: ends by chunk and raw id, else by a raw
    id that means one node in the scene; relations repaired; those without
    evidence, and roles that their entity's events contradict, dropped; the first
    of a chunk's equal claims; events without a role get their first participant;
    then merged and reversed, with the names of their ends.
    """
    scene = ["story_id", "scene_no"]
    none = F.array().cast("array<string>")
    raw = events.select(*KEYS, "pos", "temp_id", F.lit("Event").alias("type"), "name", F.array("name").alias("forms"), "description", "evidence", "participants", none.alias("linked")).unionByName(
        entities.select(*KEYS, "pos", "temp_id", "type", F.col("canonical_name").alias("name"), F.coalesce("surface_forms", none).alias("forms"), "description", "evidence", none.alias("participants"),
                        F.coalesce("linked_events", none).alias("linked")))
    raw = raw.filter(F.trim("name") != "").withColumn("evidence", extraction.clean_evidence(F.coalesce("evidence", none)))
    forms = extraction.surface_forms(F.col("name"), F.col("forms"), F.col("type"), F.col("evidence"))
    raw = raw.withColumn("aliases", extraction.clean_aliases(F.col("name"), forms, F.col("type"))).withColumn("description", F.coalesce("description", F.lit("")))
    # A scene is part of every key, so operators that know no scenes keep scenes apart.
    raw = raw.withColumn("part", _key(*scene)).withColumn("raw_id", _key("part", "chunk_id", "type", "temp_id", F.col("pos").cast("string")))
    if provider is not None:
        order = F.row_number().over(Window.partitionBy("part", "type").orderBy("chunk_id", "pos"))
        given = raw.select(F.col("part").alias("story_id"), "type", F.col("raw_id").alias("id"), order.alias("pos"), "name", "description")
        renamed = given.sparkSession.createDataFrame([], "story_id string, src string, dst string") if renames is None else (
            raw.select("story_id", F.col("part").alias("p")).distinct().join(renames, "story_id").select(F.col("p").alias("story_id"), "src", "dst"))
        left, went = resolve.resolution(given, renamed, provider)
        names = left.select(F.col("story_id").alias("part"), F.col("id").alias("went"), F.col("name").alias("new_name"), F.col("aliases").alias("more"))
        went = went.select(F.col("story_id").alias("part"), "raw_id", F.col("id").alias("went")).join(names, ["part", "went"])
        raw = raw.join(went, ["part", "raw_id"]).withColumn("name", F.col("new_name")).withColumn("aliases", F.array_union("aliases", "more")).drop("went", "new_name", "more")
    raw = raw.withColumn("key", F.concat_ws("::", "type", text.norm_graph(F.col("name"), F.col("type"))))
    raw = cut(raw.withColumn("id", F.concat(F.lit("n_"), F.substring(F.md5(_key("part", "key")), 1, 12))))
    order = F.struct("chunk_id", "pos")
    nodes = raw.groupBy(*scene, "id").agg(
        F.first("type").alias("type"), F.min_by("name", order).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.max_by("description", F.struct(F.length("description"), "chunk_id")).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
        F.array(F.col("scene_no").cast("string")).alias("scene_refs"), F.min("pos").alias("pos"))
    nodes = cut(nodes)

    registry = raw.select("part", F.col("chunk_id").alias("chunk"), "temp_id", "id")
    chunk_map = graph.resolve_ids(registry.select(_key("part", "chunk", "temp_id").alias("raw_id"), F.col("id").alias("canonical"))).select(F.lit("").alias("chunk_id"), "raw_id", "canonical")
    id_map = graph.resolve_ids(registry.select(_key("part", "temp_id").alias("raw_id"), F.col("id").alias("canonical")))
    of = relations.withColumn("part", _key(*scene)).withColumn("n", F.monotonically_increasing_id())
    joined = of
    for end in ("source", "target"):
        by_chunk = chunk_map.select(F.col("raw_id").alias(f"{end}_1"), F.col("canonical").alias(f"{end}_a"))
        by_id = id_map.select(F.col("raw_id").alias(f"{end}_2"), F.col("canonical").alias(f"{end}_b"))
        joined = joined.withColumn(f"{end}_1", _key("part", "chunk_id", f"{end}_id")).withColumn(f"{end}_2", _key("part", f"{end}_id")).join(by_chunk, f"{end}_1", "left").join(by_id, f"{end}_2", "left")
        joined = joined.withColumn(end, F.coalesce(f"{end}_a", f"{end}_b")).drop(f"{end}_1", f"{end}_2", f"{end}_a", f"{end}_b")
    joined = joined.filter("source <> target").withColumn("evidence", extraction.clean_evidence(F.coalesce("evidence", none))).filter("size(evidence) > 0")
    joined = extraction.first_wins(joined, ["part", "chunk_id", "source", "relation", "target"], ["pos"])
    typed = graph.typed_edges(joined.select("part", "source", "relation", "target", "evidence", "confidence", "target_id"), nodes.select("id", "type"))
    repaired = graph.repair_relations(typed)
    known = raw.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("linked"))).alias("linked"), F.array_distinct(F.flatten(F.collect_list("participants"))).alias("participants"))
    who = nodes.select(F.col("id").alias("source"), F.col("name").alias("who")).join(known.select(F.col("id").alias("source"), "linked"), "source")
    event = known.select(F.col("id").alias("target"), "participants")
    sane = repaired.join(who, "source").join(event, "target").filter(extraction.role_sane(F.col("relation"), F.col("target_id"), F.col("linked"), F.col("participants"), F.col("who")))
    edges = cut(graph.dedupe_edges(sane.select("source", "relation", "target", "evidence", "confidence")))

    bare = graph.uncovered_events(nodes.select("id", "type", *scene, "description", F.col("evidence").alias("shown")), edges)
    said = F.coalesce(F.get("shown", F.lit(0)), F.nullif("description", F.lit("")))
    happened = bare.join(known.select("id", "participants"), "id").select(
        _key(*scene).alias("part"), F.col("id").alias("event_id"), "participants", F.when(said.isNull(), none).otherwise(F.array(said)).alias("evidence"))
    acting = nodes.select(_key(*scene).alias("part"), F.col("id").alias("entity_id"), "pos", "type", "name")
    edges = cut(edges.unionByName(extraction.cover_events(happened, acting, "part", COVERED).drop("part")))
    edges = edges.unionByName(graph.reverse_edges(edges))
    place = nodes.select(F.col("id").alias("source"), *scene)
    stamped = extraction.stamp_names(edges.withColumnsRenamed({"source": "source_id", "target": "target_id"}), nodes.select("id", F.col("id").alias("temp_id"), "name", "pos")).withColumnsRenamed({"source_id": "source", "target_id": "target"})
    return nodes, stamped.join(place, "source").select(
        *scene, "source", "relation", "target", "evidence", "confidence", "source_name", "target_name", F.array(F.col("scene_no").cast("string")).alias("scene_refs"))


def attribute_profiles(scenes: DataFrame, provider: Provider, cache: DataFrame | None = None) -> DataFrame:
    """(story_id, scene_no, pos, entity, attr, value) of each scene's profile."""
    rows = scenes.select("story_id", "scene_no", F.lit("scene").alias("chunk_id"), F.col("content").alias("body"))
    found = ask(rows, "attributes", provider, "", cache).select("story_id", "scene_no", F.explode(F.from_json("answer", "map<string, map<string, string>>")).alias("entity", "m"))
    flat = found.select("story_id", "scene_no", "entity", F.explode("m").alias("attr", "value"))
    return flat.withColumn("pos", F.row_number().over(Window.partitionBy("story_id", "scene_no").orderBy("entity", "attr")))


def propose(attributes: DataFrame) -> DataFrame:
    """(story_id, index, pos, x, y, fact, event, text): a proposal per changed value, near-duplicates dropped, in scene order."""
    c = facts.value_changes(attributes)
    pos = F.row_number().over(Window.partitionBy("story_id").orderBy("scene_no", "entity", "attr"))
    p = c.select("story_id", pos.alias("pos"), F.col("previous_scene").alias("x"), F.col("scene_no").alias("y"),
                 F.concat_ws(" ", "entity", F.lit("having"), "attr", "previous").alias("fact"), F.concat_ws(" ", "entity", F.lit("having"), "attr", "value").alias("event"), "entity", "attr", "previous", "value")
    kept = verify.near_duplicates(p).filter("kept").drop("kept")
    n = F.row_number().over(Window.partitionBy("story_id").orderBy("pos"))
    return kept.withColumn("text", text.render_finding(F.col("x"), F.col("fact"), F.col("y"), F.col("event"))).filter("text <> ''").withColumn("index", n)


#: Stored proposals, as ``propose_by_provider`` gives them.
PROPOSALS = "story_id string, pos int, x int, y int, fact string, event string, text string, index int"
PROPOSAL = "array<struct<x: string, y: string, fact: string, event: string>>"


def propose_by_provider(nodes: DataFrame, edges: DataFrame, attributes: DataFrame, provider: Provider, cache: DataFrame | None = None) -> DataFrame:
    """Proposals that a provider finds: per later scene one request with what was before and the scene's facts.

    Nodes, edges and attributes carry story_id, scene_no and pos.  A story's
    first scene, and scenes without facts, are not asked about.  A clause that
    is empty or scenes that are not in order drop a proposal; a scene y that is
    no number is the scene asked about; the first of equal texts stays, then
    near-duplicates go.  The summary grows with the story, so the requests of a
    story grow with the square of its scenes, as they must.
    """
    if "pos" not in edges.columns:
        edges = edges.withColumn("pos", F.row_number().over(Window.partitionBy("story_id", "scene_no").orderBy("source", "relation", "target")))
    lines = facts.prior_summary(nodes, edges, attributes)
    found = facts.candidate_facts(nodes, edges, attributes).groupBy("story_id", "scene_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("f"))
    scenes = lines.join(found, ["story_id", "scene_no"], "full")
    before = Window.partitionBy("story_id").orderBy("scene_no").rowsBetween(Window.unboundedPreceding, -1)
    asked = scenes.withColumn("prior", F.flatten(F.collect_list(F.coalesce("lines", F.array().cast("array<string>"))).over(before))).filter("size(prior) > 0 and f is not null")
    body = F.concat_ws("\n", F.array_join("prior", "\n"), F.concat(F.lit("\nSCENE "), F.col("scene_no").cast("string")), F.array_join(F.transform("f", lambda x: x["text"]), "\n"))
    replies = ask(asked.select("story_id", "scene_no", F.lit("scene").alias("chunk_id"), body.alias("body")), "propose", provider, "", cache)
    rows = replies.select("story_id", "scene_no", F.posexplode(F.from_json("answer", PROPOSAL)).alias("n", "p"))
    x, y = F.col("p.x").try_cast("int"), F.coalesce(F.col("p.y").try_cast("int"), F.col("scene_no"))
    rows = rows.select("story_id", "scene_no", "n", x.alias("x"), y.alias("y"), text.proposal_fact(F.col("p.fact")).alias("fact"), text.proposal_event(F.col("p.event")).alias("event"))
    rows = rows.withColumn("text", text.render_finding(F.col("x"), F.col("fact"), F.col("y"), F.col("event"))).filter("text <> ''")
    once = rows.groupBy("story_id", "text").agg(F.min(F.struct("scene_no", "n", "x", "y", "fact", "event")).alias("p"))
    order = Window.partitionBy("story_id").orderBy("p.scene_no", "p.n")
    kept = verify.near_duplicates(once.select("story_id", F.row_number().over(order).alias("pos"), "p.x", "p.y", "p.fact", "p.event", "text")).filter("kept").drop("kept")
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("story_id").orderBy("pos")))


def verify_proposals(proposals: DataFrame, scenes: DataFrame, provider: Provider) -> DataFrame:
    """Proposals with decisions and grounded quotes; a batch of 12 is one request, and a failed one keeps its proposals."""
    content = scenes.select("story_id", "scene_no", "content")
    both = proposals.join(content.toDF("story_id", "x", "x_text"), ["story_id", "x"], "left").join(content.toDF("story_id", "y", "y_text"), ["story_id", "y"], "left")
    ends = ("fact", "event") if "entity" not in proposals.columns else (F.concat_ws(" ", "entity", F.lit("has"), "attr", "previous"), F.concat_ws(" ", "entity", F.lit("has"), "attr", "value"))
    line = F.concat_ws("\t", F.col("index").cast("string"), *ends)
    batches = both.groupBy("story_id", (F.floor((F.col("index") - 1) / BATCH) + 1).cast("int").alias("scene_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    replies = ask(batches.withColumn("chunk_id", F.lit("batch")), "verify", provider).select("story_id", F.from_json("answer", "struct<results: array<struct<index: int, decision: string, attribute: string, prior_quote: string, later_quote: string>>>").alias("r"))
    entries = replies.select("story_id", F.posexplode("r.results").alias("pos", "e")).select("story_id", "pos", "e.*")
    decided = verify.decide(both, entries)
    quotes = entries.groupBy("story_id", "index").agg(F.max_by("prior_quote", "pos").alias("prior_quote"), F.max_by("later_quote", "pos").alias("later_quote"))
    return decided.join(quotes, ["story_id", "index"], "left").withColumn("prior_grounded", verify.grounded(F.col("prior_quote"), F.col("x_text"))).withColumn("later_grounded", verify.grounded(F.col("later_quote"), F.col("y_text"))).drop("x_text", "y_text")


def detect(scenes: DataFrame, provider: Provider, proposals: DataFrame | None = None) -> DataFrame:
    """(story_id, id, hallucination) of all stories: proposals that were confirmed or kept, numbered.

    Without given proposals (a provider's, or stored ones to verify again) every
    changed value is one.
    """
    asked = propose(attribute_profiles(scenes, provider)) if proposals is None else proposals
    found = verify_proposals(asked, scenes, provider).filter("final_decision <> 'rejected'")
    return found.withColumn("id", F.row_number().over(Window.partitionBy("story_id").orderBy("index"))).select("story_id", "id", F.col("text").alias("hallucination"))


def audit(nodes: DataFrame, edges: DataFrame, attributes: DataFrame, proposals: DataFrame, verified: DataFrame) -> DataFrame:
    """(story_id, scene_no, facts, proposed, kept, confirmed, rejected): what the verifier saw and decided, per later scene."""
    keys = ["story_id", "scene_no"]
    if "pos" not in edges.columns:
        edges = edges.withColumn("pos", F.lit(0))
    seen = facts.candidate_facts(nodes, edges, attributes).groupBy(*keys).agg(F.count("*").alias("facts"))
    asked = proposals.groupBy("story_id", F.col("y").alias("scene_no")).agg(F.count("*").alias("proposed"))
    done = verified.groupBy("story_id", F.col("y").alias("scene_no")).agg(*[F.count_if(F.col("final_decision") == d).alias(d) for d in ("kept", "confirmed", "rejected")])
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("facts", "proposed", "kept", "confirmed", "rejected")]
    return seen.join(asked, keys, "full").join(done, keys, "full").select(*keys, *counts)


def judge_prompt(scenes: DataFrame) -> DataFrame:
    """(story_id, body): a whole story's scenes in order, for a provider that reads it at once."""
    tagged = F.struct("scene_no", F.concat(F.lit("SCENE "), F.col("scene_no").cast("string"), F.lit("\n"), F.col("content")).alias("t"))
    return scenes.groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(tagged)), lambda x: x["t"]), "\n\n").alias("body"))


def judge(scenes: DataFrame, provider: Provider) -> DataFrame:
    """(story_id, id, hallucination) of the whole-story judge: parsed findings in scene order, the first of equal texts."""
    rows = judge_prompt(scenes).select("story_id", F.lit(0).alias("scene_no"), F.lit("story").alias("chunk_id"), "body")
    found = ask(rows, "judge", _Judge(provider)).select("story_id", F.posexplode(F.from_json("answer", "array<struct<hallucination: string>>")).alias("pos", "f")).select("story_id", "pos", "f.hallucination")
    p = found.withColumn("p", text.parse_finding(F.col("hallucination"))).filter("p.x < p.y")
    first = p.groupBy("story_id", "hallucination").agg(F.min("pos").alias("pos"))
    return first.withColumn("id", F.row_number().over(Window.partitionBy("story_id").orderBy("pos"))).select("story_id", "id", "hallucination")


def evaluate(gold: DataFrame, predicted: dict[str, DataFrame], threshold: float = score.THRESHOLD) -> DataFrame:
    """Rows per story and method with the aggregate per method; a story without gold has no rates."""
    rows = None
    for method, df in predicted.items():
        pred = df.select("story_id", F.col("id").alias("pos"), "hallucination")
        one = score.match(gold.select("story_id", "pos", "hallucination"), pred, threshold).withColumn("method", F.lit(method))
        rows = one if rows is None else rows.unionByName(one)
    return score.rollup(rows, "method", "story_id")
