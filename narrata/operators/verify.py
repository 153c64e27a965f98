"""Proposals and their verification: near-duplicates, quote grounding, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import text


def grounded(quote: Column, scene: Column, least: float = 0.30, least_tokens: int = 3) -> Column:
    """A quote stands in a scene: as a substring, or some window of its length has a token Jaccard of ``least``.

    Quotes of under ``least_tokens`` tokens need the substring.  The tokens are
    found once, in a one-element array that the windows run over; the substring
    test comes first.
    """
    def near(t):
        window = F.greatest(F.size(t["q"]), F.lit(4))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t["s"]) - window + 1))
        return (F.size(t["q"]) >= least_tokens) & (F.size(t["s"]) > 0) & F.exists(starts, lambda i: _at_least(t["d"], F.array_distinct(F.slice(t["s"], i, window)), least))

    q = text.ascii_tokens(quote)
    tokens = F.array(F.struct(q.alias("q"), F.array_distinct(q).alias("d"), text.ascii_tokens(scene).alias("s")))
    empty = (F.coalesce(quote, F.lit("")) == "") | (F.coalesce(scene, F.lit("")) == "")
    return F.when(empty, F.lit(False)).when(F.lower(scene).contains(F.lower(quote)), F.lit(True)).otherwise(F.element_at(F.transform(tokens, near), 1))


def _at_least(a: Column, b: Column, least: float) -> Column:
    return F.size(F.array_intersect(a, b)) >= F.lit(least) * F.size(F.array_union(a, b))


def near_duplicates(proposals: DataFrame, jaccard: float = 0.5, shared: float = 0.30) -> DataFrame:
    """Proposals with ``kept``: greedy within (story_id, x, y), in the order of ``pos``.

    One goes if an earlier kept one shares ``jaccard`` of the tokens, or
    ``shared`` of them and a named entity; without tokens it stays.
    """
    body = F.concat_ws(" ", "fact", "event")
    items = proposals.groupBy("story_id", "x", "y").agg(F.array_sort(F.collect_list(F.struct("pos", text.dedupe_tokens(body).alias("t"), text.entity_keys(body).alias("e")))).alias("items"))

    def step(kept, p):
        def same(k):
            inter, union = F.size(F.array_intersect(k["t"], p["t"])), F.size(F.array_union(k["t"], p["t"]))
            tokens = (F.size(k["t"]) > 0) & (F.size(p["t"]) > 0)
            return tokens & ((inter >= F.lit(jaccard) * union) | (F.arrays_overlap(k["e"], p["e"]) & (inter >= F.lit(shared) * union)))

        return F.when(F.exists(kept, same), kept).otherwise(F.concat(kept, F.array(p)))

    empty = F.filter("items", lambda x: F.lit(False))
    kept = items.select("story_id", "x", "y", F.explode(F.aggregate("items", empty, step)).alias("k")).select("story_id", "x", "y", F.col("k.pos").alias("pos"), F.lit(True).alias("kept"))
    return proposals.join(kept, ["story_id", "x", "y", "pos"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def decide(proposals: DataFrame, entries: DataFrame) -> DataFrame:
    """Proposals (story_id, index, ...) with the verifier's entries (story_id, index, pos, decision, attribute, quotes).

    The last entry of an index counts; none keeps the proposal; anything but a
    full confirm rejects it.
    """
    last = entries.groupBy("story_id", "index").agg(F.max_by(F.struct("decision", "attribute", "prior_quote", "later_quote"), "pos").alias("d"))
    full = (F.trim(F.coalesce("d.attribute", F.lit(""))) != "") & (F.trim(F.coalesce("d.prior_quote", F.lit(""))) != "") & (F.trim(F.coalesce("d.later_quote", F.lit(""))) != "")
    final = F.when(F.col("d").isNull(), "kept").when(F.lower("d.decision") != "confirm", "rejected").when(full, "confirmed").otherwise("rejected")
    model = F.when(F.col("d").isNull(), "missing").otherwise(F.lower(F.coalesce("d.decision", F.lit(""))))
    return proposals.join(last, ["story_id", "index"], "left").withColumn("model_decision", model).withColumn("final_decision", F.coalesce(final, F.lit("rejected"))).drop("d")
