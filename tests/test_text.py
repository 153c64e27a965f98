from pyspark.sql import functions as F

from narrata.functions import text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("r")).first()["r"]


def test_name_keys(spark):
    c = F.lit("Character")
    assert one(spark, text.norm_graph(F.col("n"), c), n="Dr. Márcus's Töne") == "marcus tone"
    assert one(spark, text.norm_resolution(F.col("n"), c), n="Marcus's") == "marcus s"
    assert one(spark, text.norm_graph(F.col("n"), c), n="Captain") == "captain"
    assert one(spark, text.norm_graph(F.col("n"), F.lit("Object")), n="Captain Log") == "captain log"
    assert one(spark, text.norm_relation(F.col("n")), n=" A--b C ") == "a b c"
    assert one(spark, text.slug(F.col("n")), n="--") == "chunk"


def test_score_tokens(spark):
    assert set(one(spark, text.score_tokens(F.col("t")), t="The two dogs were running; he jumped")) == {"2", "dog", "runn", "he", "jump"}
    assert one(spark, text.score_tokens(F.col("t")), t="was the said") == []
    assert set(one(spark, text.score_tokens(F.col("t")), t="Seven kings walked")) == {"7", "king", "walk"}


def test_overlaps(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("x"))
    e = F.filter(F.array(F.lit("x")), lambda x: F.lit(False))
    row = spark.range(1).select(text.jaccard(a, b), text.soft_overlap(a, b), text.jaccard(e, e), text.soft_overlap(e, b)).first()
    assert tuple(row) == (0.5, 1.0, 1.0, 0.0)


def test_template(spark):
    p = text.parse_finding(F.col("t"))
    strict = one(spark, p, t="In scene 1, Ada had a red coat was established, yet in scene 3, the coat is blue happens.")
    assert (strict.x, strict.fact, strict.y, strict.event) == (1, "Ada had a red coat", 3, "the coat is blue")
    lenient = one(spark, p, t="in scene 2, Ada was introduced as a nurse , yet in scene 4, she is a pilot.")
    assert (lenient.x, lenient.fact, lenient.y, lenient.event) == (2, "Ada", 4, "she is a pilot")
    assert one(spark, p, t="nothing here") is None
    r = text.render_finding(F.col("x"), F.lit("a"), F.col("y"), F.lit("b"))
    assert one(spark, r, x=1, y=2) == "In scene 1, a was established, yet in scene 2, b happens"
    assert one(spark, r, x=2, y=2) == ""


def test_clauses(spark):
    assert one(spark, text.score_fact(F.col("t")), t=" a coat, was established early on") == "a coat"
    assert one(spark, text.score_event(F.col("t")), t="it rains — as said happens.") == "it rains"
    assert one(spark, text.proposal_fact(F.col("t")), t="x is established.") == "x"


def test_durable_and_aliases(spark):
    assert one(spark, text.is_durable(F.col("t")), t="Her RED hat")
    assert one(spark, text.is_durable(F.col("t")), t="room 12")
    assert not one(spark, text.is_durable(F.col("t")), t="a12b walks")
    assert one(spark, text.generic_alias(F.col("t")), t="the Captain")
    assert not one(spark, text.generic_alias(F.col("t")), t="Captain Ada")
    assert sorted(one(spark, text.entity_keys(F.col("t")), t="Ada met The Zoé and Bob on Mars")) == ["ada", "bob", "mars"]


def test_encoding(spark):
    assert one(spark, text.fix_encoding(F.col("t")), t="a\r\nb\rcÂ d﻿") == "a\nb\nc d"


def test_fold_is_compatibility_decomposition(spark):
    """Every character of the planes that decompose, against the standard library."""
    import unicodedata

    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    lines = ["".join(chars[i : i + 64]) for i in range(0, len(chars), 64)] + ["Dvořák Škoda", "Nguyễn Thị Ánh", "İstanbul ığüşöç", "Łódź Żółć", "Ｆｕｌｌ ｗｉｄｔｈ", "ﬁne ½ ℡ 𝐁𝐨𝐥𝐝", "日本 ok", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = {r.i: r.f for r in df.select("i", text.fold(F.col("t")).alias("f")).collect()}
    for i, line in enumerate(lines):
        assert got[i] == unicodedata.normalize("NFKD", line).encode("ascii", "ignore").decode(), line
    assert one(spark, text.norm_graph(F.col("n"), F.lit("Character")), n="Dr. Dvořák Škoda") == "dvorak skoda"
