"""Scoring findings against gold: one-to-one greedy matching, precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import text

THRESHOLD = 0.35


def parsed(findings: DataFrame, col: str = "hallucination") -> DataFrame:
    """Adds x, y and the token sets of the clauses; an unparsed finding is all fact and has no scenes."""
    p = text.parse_finding(F.coalesce(F.col(col), F.lit("")))
    out = findings.withColumn("p", p)
    fact = F.when(F.col("p").isNull(), F.col(col)).otherwise(text.score_fact(F.col("p.fact")))
    event = F.when(F.col("p").isNull(), F.lit("")).otherwise(text.score_event(F.col("p.event")))
    return out.withColumn("x", F.col("p.x")).withColumn("y", F.col("p.y")).withColumn("fact_tokens", text.score_tokens(fact)).withColumn("event_tokens", text.score_tokens(event)).drop("p")


def candidates(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(story_id, g, p, score): pairs whose clauses both overlap enough.

    Findings with scenes join on them; findings without meet the others of
    their story, which is all that such a finding allows.
    """
    cols = ["story_id", "x", "y", "fact_tokens", "event_tokens"]
    g = parsed(gold).select(F.col("pos").alias("g"), *[F.col(c).alias(f"g_{c}") for c in cols])
    p = parsed(pred).select(F.col("pos").alias("p"), *[F.col(c).alias(f"p_{c}") for c in cols])
    story = F.col("g_story_id") == F.col("p_story_id")
    both = g.filter("g_x is not null").join(p.filter("p_x is not null"), story & (F.col("g_x") == F.col("p_x")) & (F.col("g_y") == F.col("p_y")))
    bare = g.filter("g_x is null").join(p, story).unionByName(g.filter("g_x is not null").join(p.filter("p_x is null"), story))
    fact, event = text.soft_overlap(F.col("g_fact_tokens"), F.col("p_fact_tokens")), text.soft_overlap(F.col("g_event_tokens"), F.col("p_event_tokens"))
    rows = both.unionByName(bare).withColumn("fact", fact).withColumn("event", event).filter((F.col("fact") >= threshold) & (F.col("event") >= threshold))
    return rows.select(F.col("g_story_id").alias("story_id"), "g", "p", F.least("fact", "event").alias("score"))


def greedy(pairs: DataFrame) -> DataFrame:
    """(story_id, g, p): best score first, ties by (g, p), each side once; a fold over a story's sorted candidates."""
    one = F.struct((-F.col("score")).alias("s"), "g", "p")
    sorted_ = pairs.groupBy("story_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    empty = F.filter("c", lambda x: F.lit(False))
    taken = F.aggregate("c", empty, lambda acc, x: F.when(F.exists(acc, lambda a: (a["g"] == x["g"]) | (a["p"] == x["p"])), acc).otherwise(F.concat(acc, F.array(x))))
    return sorted_.select("story_id", F.explode(taken).alias("m")).select("story_id", "m.g", "m.p")


def match(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(story_id, gold, pred, tp, fp, fn) of (story_id, pos, hallucination) tables."""
    tp = greedy(candidates(gold, pred, threshold)).groupBy("story_id").agg(F.count("*").alias("tp"))
    g, p = (df.groupBy("story_id").agg(F.count("*").alias(n)) for df, n in ((gold, "gold"), (pred, "pred")))
    zero = F.lit(0)
    out = g.join(p, "story_id", "full").join(tp, "story_id", "left").select("story_id", F.coalesce("gold", zero).alias("gold"), F.coalesce("pred", zero).alias("pred"), F.coalesce("tp", zero).alias("tp"))
    return out.withColumn("fp", F.col("pred") - F.col("tp")).withColumn("fn", F.col("gold") - F.col("tp"))


def rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; zero where a denominator is."""
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(rate(2 * p * r, p + r), 4))


def rollup(rows: DataFrame, method: str, story: str) -> DataFrame:
    """Rows per (method, story) and per method, rates from summed counts."""
    sums = rows.rollup(method, story).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).filter(F.col(method).isNotNull())
    return with_rates(sums.withColumn(story, F.coalesce(F.col(story), F.lit("AGGREGATE"))))
