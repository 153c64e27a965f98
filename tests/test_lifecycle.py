from narrata.plans import lifecycle, providers
from narrata.sources import stories

SCENES = [("m", 1, "Ada has coats 2. Bob ran home."), ("m", 2, "Ada has coats 2."), ("m", 3, "Ada has coats 5. Bob slept."), ("n", 1, "Cid has hats 1."), ("n", 2, " ")]


def test_detect_and_score(spark):
    scenes = spark.createDataFrame(SCENES, "story_id string, scene_no int, content string")
    found = lifecycle.detect(scenes, providers.StubProvider())
    rows = found.collect()
    assert [(r.story_id, r.id) for r in rows] == [("m", 1)] and "scene 2" in rows[0].hallucination and "scene 3" in rows[0].hallucination
    gold = spark.createDataFrame([("m", 0, rows[0].hallucination)], "story_id string, pos int, hallucination string")
    out = {(r.method, r.story_id): (r.tp, r.fp, r.fn, r.f1) for r in lifecycle.evaluate(gold, {"graph": found}).collect()}
    assert out[("graph", "AGGREGATE")] == (1, 0, 0, 1.0)


def test_graph_of_scenes(spark):
    scenes = spark.createDataFrame(SCENES, "story_id string, scene_no int, content string")
    nodes, edges = lifecycle.assemble(*lifecycle.extract(scenes, providers.StubProvider()))
    assert {(r.story_id, r.scene_no, r["type"]) for r in nodes.collect()} >= {("m", 1, "Character"), ("m", 1, "Event"), ("n", 1, "Event")}
    assert {r.relation for r in edges.collect()} == {"performs"}


def test_providers():
    calls = []

    def flaky(**kw):
        calls.append(kw)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "[1]"

    p = providers.CallableProvider(flaky, wait=0)
    assert providers.answer(p, "events", "x") == [1] and len(calls) == 3
    assert providers.answer(providers.CallableProvider(lambda **k: 1 / 0, wait=0), "events", "x") is None
    key = providers.ReplayProvider.key("judge", "judge\nbody")
    assert providers.answer(providers.ReplayProvider({key: "[]"}), "judge", "body") == []


def test_cache(spark):
    rows = spark.createDataFrame([("s", 1, "c", "Ada ran.")], "story_id string, scene_no int, chunk_id string, body string")
    first = lifecycle.ask(rows, "events", providers.StubProvider()).collect()
    held = spark.createDataFrame([(first[0].cache_key, "[]")], "cache_key string, answer string")
    assert [r.answer for r in lifecycle.ask(rows, "events", providers.StubProvider(), cache=held).collect()] == ["[]"]


def test_sources(spark, tmp_path):
    import json
    d = tmp_path / "one"
    d.mkdir()
    (d / "script.json").write_text(json.dumps([{"_id": 0, "title": "INT. HOUSE", "content": "Ada."}, {"_id": 1, "title": "Road", "content": "x" * 2000}]))
    chunk = lambda i, t: {"id": i, "content": t, "source_doc_id": "d", "start_pos": 0, "end_pos": len(t)}
    (d / "doc2chunks.json").write_text(json.dumps({"scene_2_part_1": {"document_metadata": {"region": "r"}, "chunks": [chunk("a", "x")]}, "scene_2_part_2": {"chunks": [chunk("b", "y")]}, "scene_2_part_4": {"chunks": [chunk("c", "z")]}}))
    rows = {r.scene_no: r for r in stories.read_corpus(spark, str(tmp_path)).collect()}
    assert rows[1].category == "INT" and len(rows[1].chunks) == 1 and rows[1].chunks[0].content == "Ada."
    assert [c.id for c in rows[2].chunks] == ["a", "b"] and rows[2].category == "UNKNOWN"
    nodes = spark.createDataFrame([("one", 1, 0, "n1", "Character", "Ada")], "story_id string, scene_no int, pos int, id string, type string, name string")
    edges = spark.createDataFrame([("one", 1, "n1", "performs", "n2")], "story_id string, scene_no int, source string, relation string, target string")
    assert "n1 performs" not in stories.graph_pages(nodes, edges).first().html and "performs" in stories.graph_pages(nodes, edges).first().html
    assert stories.incomplete(stories.read_corpus(spark, str(tmp_path)), nodes).first().found == 1
    stories.write_graphs(nodes, edges, str(tmp_path / "out"))
    assert (tmp_path / "out" / "story_id=one" / "scene_no=1").exists()
    (tmp_path / "m.json").write_text('[{"story_id": "one", "movie_dir": "one"}]')
    assert stories.read_manifest(spark, str(tmp_path / "m.json")).first().movie_dir == f"{tmp_path}/one"
    assert stories.read_findings(spark, str(tmp_path / "none" / "*.json")).count() == 0


def test_judge(spark):
    scenes = spark.createDataFrame(SCENES, "story_id string, scene_no int, content string")
    said = "In scene 1, Ada is  tall was established, yet in scene 3, Ada is short happens."
    prose = providers.CallableProvider(lambda **k: f"I see: {said} And {said} In scene 3, a was established, yet in scene 2, b happens")
    assert {(r.story_id, r.id, r.hallucination) for r in lifecycle.judge(scenes, prose).collect()} == {(s, 1, said.replace("  ", " ")) for s in ("m", "n")}
    listed = providers.CallableProvider(lambda **k: '[{"hallucination": "In scene 1, x, yet in scene 2, y"}]')
    assert lifecycle.judge(scenes, listed).count() == 2


def test_proposals_of_a_provider(spark):
    stub = providers.StubProvider()
    scenes = spark.createDataFrame(SCENES, "story_id string, scene_no int, content string")
    attributes = lifecycle.attribute_profiles(scenes, stub)
    nodes, edges = lifecycle.assemble(*lifecycle.extract(scenes, stub))
    from pyspark.sql import functions as F
    proposals = lifecycle.propose_by_provider(nodes, edges.withColumn("pos", F.lit(0)), attributes, stub)
    assert [(r.story_id, r["index"], r.x, r.y) for r in proposals.collect()] == [("m", 1, 2, 3)]
    assert lifecycle.detect(scenes, stub, proposals).count() == 1


EVENTS = [
    # story, scene, chunk, pos, temp_id, name, description, evidence, participants
    ("s", 1, "c1", 0, "e1", "Ada opens the door", "", ["Ada opens  the door."], ["Ada"]),
    ("s", 1, "c1", 1, "e2", "Bob leaves", "Bob walks out", [], ["Dr. Bob Hale", "nobody"]),
    ("s", 1, "c2", 0, "e1", "Rain falls", "", ["It rained."], []),
]
ENTITIES = [
    ("s", 1, "c1", 0, "n1", "Character", "Ada", ["Ada", "she"], "", ["Ada"], ["e1"]),
    ("s", 1, "c1", 1, "n2", "Character", "Bob", [], "", [], None),
    ("s", 1, "c2", 0, "n1", "Character", "Ada Byron", ["Captain"], "a countess", ["Ada Byron"], []),
    ("s", 1, "c2", 1, "n9", "Object", "door", ["gate"], "", ["the door"], []),
]
RELATIONS = [
    ("s", 1, "c1", 0, "n1", "performs", "e1", ["Ada opens the door."], 0.9),
    ("s", 1, "c1", 1, "n1", "performs", "e1", ["again"], 0.4),  # the same claim of a chunk: the first counts
    ("s", 1, "c1", 2, "n1", "performs", "e2", ["Ada leaves?"], 0.9),  # her events don't include it, nor its people her
    ("s", 1, "c2", 0, "n1", "owns", "n9", ["hers"], 0.8),  # not a relation; two would do, so it goes
    ("s", 1, "c2", 1, "n1", "possesses", "n9", [" "], 0.8),  # no evidence
    ("s", 1, "c2", 2, "e1", "after", "e2", ["then it rained"], 0.7),  # e2 is of the other chunk, and means one node
    ("s", 1, "c2", 3, "n1", "performs", "zz", ["x"], 0.7),  # nobody knows the end
]


def raw_tables(spark):
    keys = "story_id string, scene_no int, chunk_id string, pos int, "
    return (
        spark.createDataFrame(EVENTS, keys + "temp_id string, name string, description string, evidence array<string>, participants array<string>"),
        spark.createDataFrame(ENTITIES, keys + "temp_id string, type string, canonical_name string, surface_forms array<string>, description string, evidence array<string>, linked_events array<string>"),
        spark.createDataFrame(RELATIONS, keys + "source_id string, relation string, target_id string, evidence array<string>, confidence double"))


def test_assembly(spark):
    """Prefix merge of Ada, ends by chunk and by scene, repair, sanity, first claims, coverage, names, reverse edges."""
    renames = spark.createDataFrame([("s", "door", "portal")], "story_id string, src string, dst string")
    nodes, edges = lifecycle.assemble(*raw_tables(spark), renames, providers.StubProvider())
    named = {r["name"]: r for r in nodes.collect()}
    assert set(named) == {"Ada opens the door", "Bob leaves", "Rain falls", "Ada Byron", "Bob", "portal"}
    assert "Captain" not in named["Ada Byron"].aliases and named["Ada Byron"].description == "a countess" and named["portal"].scene_refs == ["1"]
    got = {(r.source_name, r.relation, r.target_name): (r.evidence, r.confidence) for r in edges.collect()}
    assert got == {
        ("Ada Byron", "performs", "Ada opens the door"): (["Ada opens the door."], 0.9),
        ("Bob leaves", "precedes", "Rain falls"): (["then it rained"], 0.7),
        ("Rain falls", "occurs_after", "Bob leaves"): (["then it rained"], 0.7),
        ("Bob", "performs", "Bob leaves"): (["Bob walks out"], 0.6),
    }
    apart, _ = lifecycle.assemble(*raw_tables(spark))
    assert {r["name"] for r in apart.filter("type = 'Character'").collect()} == {"Ada", "Ada Byron", "Bob"}


def test_prompts_show_what_was_found(spark):
    seen = []

    class Spy(providers.StubProvider):
        def complete(self, prompt, system="", temperature=0.0, max_tokens=4096):
            if system == "relations":
                return '[{"source_id": "' + str("ENTITIES:" in prompt and "EVENTS:" in prompt) + '", "relation": "r", "target_id": "x", "evidence": ["e"]}]'
            return super().complete(prompt.split("\n\n")[0] if system == "events" else prompt, system)

    scenes = spark.createDataFrame([("m", 1, "Ada ran. Bob ran.")], "story_id string, scene_no int, content string")
    _, _, relations = lifecycle.extract(scenes, Spy(), show=True)
    assert [r.source_id for r in relations.collect()] == ["True"] and not seen


def test_dead_provider_ends_the_run():
    import pytest

    failures, dead = providers.Failures(least=5), providers.CallableProvider(lambda **k: 1 / 0, wait=0, attempts=1)
    with pytest.raises(providers.ProviderDown):
        for _ in range(5):
            assert providers.answer(dead, "events", "x", failures=failures) is None


def test_audit(spark):
    stub = providers.StubProvider()
    scenes = spark.createDataFrame(SCENES, "story_id string, scene_no int, content string")
    attributes = lifecycle.attribute_profiles(scenes, stub)
    nodes, edges = lifecycle.assemble(*lifecycle.extract(scenes, stub))
    proposals = lifecycle.propose_by_provider(nodes, edges, attributes, stub)
    verified = lifecycle.verify_proposals(proposals, scenes, stub)
    rows = {(r.story_id, r.scene_no): r for r in lifecycle.audit(nodes, edges, attributes, proposals, verified).collect()}
    assert (rows[("m", 3)].proposed, rows[("m", 3)].confirmed, rows[("m", 3)].rejected) == (1, 1, 0) and rows[("m", 2)].proposed == 0 and rows[("m", 2)].facts > 0
