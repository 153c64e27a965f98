import json

import pytest

from narrata.functions import jsonfix
from narrata.operators import score, verify


@pytest.mark.parametrize("raw, value", [
    ('{"a": 1}', {"a": 1}), ('```json\n[1, 2]\n```', [1, 2]), ('Sure: {"a": [1, 2,]} ok', [1, 2]), ('{"a": 1, // note\n "b": 2}', {"a": 1, "b": 2}),
    ('[{"a": 1}, {"b": 2', [{"a": 1}, {"b": 2}]), ("prose", None), ("", None), ('{"a": "x\\"}", "b": 1', {"a": 'x"}', "b": 1}),
])
def test_parse(raw, value):
    assert jsonfix.parse(raw) == value


def test_salvage_and_truncation():
    raw = '[{"a": 1}, {"b": "x'
    assert jsonfix.is_truncated(raw) and not jsonfix.is_truncated('{"a": "["}')
    assert jsonfix.parse(raw, "event_list") == [{"a": 1}] and jsonfix.parse(raw) is None


def test_repaired_table(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2,}'), (3, None), (4, "no")], "id int, raw string")
    assert {r.id: r.json and json.loads(r.json) for r in jsonfix.repaired(df, "id", "raw").collect()} == {1: {"a": 1}, 2: {"a": 2}, 3: None, 4: None}


def finding(x, fact, y, event):
    return f"In scene {x}, {fact} was established, yet in scene {y}, {event} happens"


def test_matching(spark):
    gold = [("s", 0, finding(1, "Ada has a red coat", 3, "her coat is blue")), ("s", 1, finding(1, "Bob owns two dogs", 2, "Bob has one dog")), ("t", 0, "unparsed prose")]
    pred = [("s", 0, finding(1, "a red coat on Ada", 3, "the blue coat")), ("s", 1, finding(2, "Bob owns two dogs", 3, "Bob has one dog")), ("s", 2, finding(1, "Ada has a red coat", 3, "her coat is blue"))]
    schema = "story_id string, pos int, hallucination string"
    rows = {r.story_id: (r.gold, r.pred, r.tp, r.fp, r.fn) for r in score.match(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)).collect()}
    assert rows == {"s": (2, 3, 1, 2, 1), "t": (1, 0, 0, 0, 1)}
    pairs = spark.createDataFrame([("s", 0, 0, 0.9), ("s", 0, 1, 0.9), ("s", 1, 0, 0.9), ("s", 1, 1, 0.2)], "story_id string, g int, p int, score double")
    assert sorted((r.g, r.p) for r in score.greedy(pairs).collect()) == [(0, 0), (1, 1)]


def test_near_duplicates_and_grounding(spark):
    p = [("s", 1, 1, 2, "Ada has a red coat", "coat turns blue"), ("s", 2, 1, 2, "Ada has red coat", "the coat turns blue"), ("s", 3, 1, 3, "Ada has a red coat", "coat turns blue"), ("s", 4, 1, 2, "", ""), ("s", 5, 1, 2, "", "")]
    df = spark.createDataFrame(p, "story_id string, pos int, x int, y int, fact string, event string")
    assert sorted(r.pos for r in verify.near_duplicates(df).filter("kept").collect()) == [1, 3, 4, 5]
    from pyspark.sql import functions as F
    q = spark.createDataFrame([("red coat", "A RED COAT here"), ("ada wore a scarlet coat", "then ada wore her old coat out"), ("two words", "other"), ("", "x"), ("a b c d", "e f")], "q string, t string")
    assert [r[0] for r in q.select(verify.grounded(F.col("q"), F.col("t"))).collect()] == [True, True, False, False, False]


def test_golden_shape(spark):
    """A story of 13 gold findings: 11 are found, two are missed; one method says nothing else, the other two things more."""
    gold = [finding(i, f"Person{i} keeps {10 + i} grey horses", i + 3, f"Person{i} owns a single mule") for i in range(1, 14)]
    said = [finding(i, f"the {10 + i} grey horses of Person{i}", i + 3, f"a single mule owned by Person{i}") for i in range(1, 12)]
    wrong = [finding(20, "It rained", 21, "it snowed"), finding(1, "The sun rose", 9, "it was noon")]
    rows = lambda x: spark.createDataFrame([("s", i, h) for i, h in enumerate(x)], "story_id string, id int, hallucination string")
    from narrata.plans import lifecycle
    out = lifecycle.evaluate(rows(gold).withColumnRenamed("id", "pos"), {"graph": rows(said), "judge": rows(said + wrong)}).collect()
    got = {(r.method, r.story_id): (r.tp + r.fn, r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in out}
    assert got[("graph", "s")] == got[("graph", "AGGREGATE")] == (13, 11, 0, 2, 1.0, 0.8462, 0.9167)
    assert got[("judge", "s")] == got[("judge", "AGGREGATE")] == (13, 11, 2, 2, 0.8462, 0.8462, 0.8462)


def test_repair_rules():
    assert jsonfix.repair('{"a": {"x": 2 , }, /* b */ "c": "x"') == '{"a": {"x": 2  },  "c": "x"}'
    assert jsonfix.repair('{"a": "http://x"}').startswith('{"a": "http:')  # comments go inside strings too
    assert json.loads(jsonfix.repair('[{"a": "x, ]", "b": 1,}, ')) == [{"a": "x, ]", "b": 1}]
    assert json.loads(jsonfix.repair('{"a": "q\\"}", "b": {"c": 1')) == {"a": 'q"}', "b": {"c": 1}}
