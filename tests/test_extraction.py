from pyspark.sql import functions as F

from narrata.operators import extraction


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_string_list(spark):
    df = rows(spark, "v string", ('["a ", "", "b"]',), ("plain",), ("5",), ('{"id": "x", "name": "n"}',), ('[{"text": "t"}, "u"]',), ('"q"',))
    assert [r[0] for r in df.select(extraction.string_list(F.col("v"))).collect()] == [["a", "b"], ["plain"], ["5"], ["n"], ["t", "u"], ["q"]]


def test_forms_and_aliases(spark):
    df = rows(spark, "c string, f array<string>, t string, e array<string>", ("Old Mill", ["the mill", "Old Mill House", "river", "stone"], "Location", ["a stone wall"]), ("Ada", ["she", "Captain", "Ada"], "Character", []))
    got = [r[0] for r in df.select(extraction.surface_forms(F.col("c"), F.col("f"), F.col("t"), F.col("e"))).collect()]
    assert got == [["Old Mill", "Old Mill House", "stone"], ["Ada", "she", "Captain"]]
    assert df.filter("t = 'Character'").select(extraction.clean_aliases(F.col("c"), F.col("f"), F.col("t"))).first()[0] == ["Ada"]


def test_participants(spark):
    e = rows(spark, "k int, event_id string, participants array<string>", (1, "v", ["the wind", "Byron", "Ada"]))
    n = rows(spark, "k int, entity_id string, pos int, type string, name string", (1, "a", 0, "Character", "Ada"), (1, "b", 1, "Character", "Ada Byron"), (1, "w", 2, "Concept", "the wind"))
    assert [tuple(r) for r in extraction.first_participants(e, n, "k").collect()] == [(1, "v", "b")]


def test_first_kept(spark):
    df = rows(spark, "s string, i int, a int, b string", ("x", 1, 1, "p"), ("x", 2, 1, "q"), ("x", 3, 2, "q"), ("x", 4, 3, "p"))
    assert sorted(r.i for r in extraction.first_kept(df, "s", "i", ["a", "b"]).collect()) == [1, 3]
    assert sorted(r.i for r in extraction.first_wins(df, ["s", "b"], ["i"]).collect()) == [1, 2]


def test_scene_at(spark):
    s = rows(spark, "s string, char_start int, char_end int, scene_no int", ("x", 0, 5, 1), ("x", 5, 9, 2))
    o = rows(spark, "s string, off int", ("x", 4), ("x", 5), ("x", 99))
    assert [r.scene_no for r in extraction.scene_at(o, s, "s", "off").orderBy("off").collect()] == [1, 2, 2]


def test_similarity(spark):
    import numpy as np

    from narrata.operators import similarity
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(60, 8))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, g int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (2048, 7):
        got = {(r.id, r["rank"]): r.neighbour for r in similarity.nearest(df, "id", "g", "v", 3, block).collect()}
        for i in range(60):
            near = sorted((j for j in range(60) if j % 2 == i % 2 and j != i), key=lambda j: -u[i] @ u[j])[:3]
            assert [got[i, r] for r in (1, 2, 3)] == near
    two = np.concatenate([rnd.normal(size=(20, 4)) + 9, rnd.normal(size=(20, 4)) - 9])
    label = similarity.kmeans(two, 2)
    assert len(set(label[:20])) == 1 and len(set(label)) == 2
    assert similarity.eigengap(np.kron(np.eye(2), np.ones((12, 12)))) >= 2
