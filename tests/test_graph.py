import pytest

from narrata import schema
from narrata.operators import graph, resolve


def test_schema():
    assert len(schema.valid_triples()) == 48
    assert schema.is_valid_triple("Event", "occurs_on", "TimePoint")
    assert not schema.is_valid_triple("Object", "possesses", "Character")
    assert schema.valid_relations("Event", "TimePoint") == ["occurs_on"]
    assert {r for _, r, _ in schema.valid_triples()} == set(schema.RELATIONS)


def test_repair(spark):
    rows = [("a", "after", "b", "Event", "Event"), ("a", "caused_by", "b", "Event", "Event"), ("a", "sits_in", "b", "Object", "Vehicle"), ("a", "owns", "b", "Concept", "Vehicle"), ("a", "before", "b", "Event", "Event")]
    got = {tuple(r) for r in graph.repair_relations(spark.createDataFrame(rows, "source string, relation string, target string, source_type string, target_type string")).select("source", "relation", "target").collect()}
    assert got == {("b", "precedes", "a"), ("b", "causes", "a"), ("a", "part_of", "b"), ("a", "precedes", "b")}


def test_reverse_is_closed(spark):
    e = spark.createDataFrame([("a", "precedes", "b", ["x"], 0.5), ("a", "kinship_with", "b", [], 0.5), ("b", "kinship_with", "a", [], 0.4)], "source string, relation string, target string, evidence array<string>, confidence double")
    assert [tuple(r)[:3] for r in graph.reverse_edges(e).select("source", "relation", "target").collect()] == [("b", "occurs_after", "a")]


def test_components(spark):
    ids = [f"{i:03d}" for i in range(60)]
    nodes = spark.createDataFrame([(i,) for i in ids + ["z"]], "id string")
    edges = spark.createDataFrame([(ids[i + 1], ids[i]) for i in range(59)], "source string, target string")
    got = dict(map(tuple, graph.components(nodes, edges).collect()))
    assert got.pop("z") == "z" and set(got.values()) == {"000"} and len(got) == 60


def test_resolve_edges(spark):
    e = spark.createDataFrame([("c1", "e1", "Character", "Ada", "performs", "v1", "Event", "Run"), ("c1", "q", "Character", "Nobody", "performs", "v1", "Event", "Run"), ("c1", "q", "Character", "Ada's", "performs", "v1", "Event", "Run")],
                              "chunk_id string, source string, source_type string, source_name string, relation string, target string, target_type string, target_name string")
    chunk = spark.createDataFrame([("c1", "e1", "N1")], "chunk_id string, raw_id string, canonical string")
    ids = spark.createDataFrame([("v1", "N2")], "raw_id string, canonical string")
    names = spark.createDataFrame([("Character::ada", "N3")], "key string, canonical string")
    assert sorted((r.source_id, r.target_id) for r in graph.resolve_edges(e, chunk, ids, names).collect()) == [("N1", "N2"), ("N3", "N2")]


@pytest.mark.parametrize("names, merged", [
    (["ada", "ada byron"], {0: 1}), (["ada byron", "ada"], {1: 0}), (["ada byron", "ada m byron"], {0: 1}), (["ada byron", "ada king"], {}), (["ada", "ada"], {}), (["-", "ada"], {}),
    (["ada", "ada byron", "ada king"], {0: 2}), (["ada king", "ada", "ada byron"], {1: 0}), (["ada b", "ada c b", "ada d c b", "ada"], {0: 2, 1: 2, 3: 0}),
])
def test_prefixes(spark, names, merged):
    n = spark.createDataFrame([("s", str(i), i, "Character", x) for i, x in enumerate(names)], "story_id string, id string, pos int, type string, name string")
    assert {int(r.id): int(r["into"]) for r in resolve.merge_prefixes(n).collect()} == merged


def test_merge_prefixes(spark):
    rows = [("s", "1", 0, "Character", "Ada"), ("s", "2", 1, "Character", "Dr. Ada Byron"), ("s", "3", 2, "Object", "Ada"), ("t", "4", 0, "Character", "Ada")]
    n = spark.createDataFrame(rows, "story_id string, id string, pos int, type string, name string")
    assert [tuple(r) for r in resolve.merge_prefixes(n).collect()] == [("s", "1", "2")]
    r = spark.createDataFrame([("s", "Ada", "Bea")], "story_id string, src string, dst string")
    assert {x.id: x["name"] for x in resolve.apply_renames(n, r).collect()} == {"1": "Bea", "2": "Dr. Ada Byron", "3": "Bea", "4": "Ada"}


def test_resolve_nodes(spark):
    from narrata.plans.providers import StubProvider

    rows = [("s", "Character", "1", 0, "Ada", "a"), ("s", "Character", "2", 1, "Ada Byron", "who writes"), ("s", "Character", "3", 2, "ada  byron", ""), ("s", "Object", "4", 3, "red lamp", "a lamp of brass"),
            ("s", "Object", "5", 4, "old red lamp", "a lamp of brass"), ("s", "Object", "6", 5, "spoon", "silver"), ("s", "Character", "7", 6, "Bea", ""), ("t", "Object", "8", 0, "lamp", "")]
    nodes = spark.createDataFrame(rows, "story_id string, type string, id string, pos int, name string, description string")
    renames = spark.createDataFrame([("s", "Bea", "Cleo")], "story_id string, src string, dst string")
    got = {r.id: (r["name"], r.aliases) for r in resolve.resolve_nodes(nodes, renames, StubProvider()).collect()}
    assert got["2"] == ("Ada Byron", ["Ada", "Ada Byron", "ada  byron"]) and "1" not in got and "3" not in got
    assert got["7"][0] == "Cleo" and got["6"][0] == "spoon" and got["8"][0] == "lamp"
    assert got["4"][0] == "old red lamp" and "5" not in got
