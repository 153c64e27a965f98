"""Mixing sources to target weights (DataFrame functions only).

Documents of a source are put in the order of a hash of their id.  Each source
is cut into ranges of that hash of about ``BUCKET`` rows; the sums of the ranges
are added up first, then the running sums within each range, so no task sees
more than a range however large a source is.  The order is taken as often as it
fits into the source's budget, and the last round is cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import WORD_CLASS

#: Documents in a range of hash keys.
BUCKET = 8192


def words_in(col: str = "text") -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most_epochs: int) -> DataFrame:
    """Adds weight and target to (source, source_size).

    Sources by code point, null last, take the weights in turn and share
    ``share`` times all sizes by them; a target stops at ``most_epochs`` times
    its source's size and the excess is shared again.  That ends where every
    uncapped source has the same target per weight (the level); sources are
    capped in the order of cap per weight, so running sums find it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.lit(share) * F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level_here"), F.struct("ratio", "level_here"))).over(everything)["level_here"])
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "n", "target")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_epochs: int = 2, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per row of ``docs``, with the columns ``carry`` as c_<name>.

    ``taken`` counts the words that the mix takes of a document, repeats
    counted: its size in each whole round of its source, and in the cut round
    what the budget leaves.  The taken words of a source sum to its target,
    rounded to a word.  Null text has size 0; a null source is a source of its
    own; rows that repeat a doc_id are documents of their own, and those with
    equal size too are interchangeable.  Reruns agree.  Texts of any length are
    counted whole; other columns are ignored, whatever their names.  An empty
    table gives an empty result.
    """
    folder = common.shared_dir(docs.sparkSession)
    carried = [F.col(f"`{c}`").alias(f"c_{c}") for c in carry]
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in().alias("size"), *carried).withColumn(
        "key", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long"))
    sized = common.stored(sized, folder, "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = common.stored(targets(sources, weights, share, most_epochs), folder, "sources").withColumnRenamed("source", "s")
    dealt = sized.join(sources, sized.source.eqNullSafe(sources.s)).drop("s").withColumn(
        "range", F.floor(F.col("key") / F.lit(float(1 << 52)) * F.ceil(F.col("n") / F.lit(float(BUCKET)))))
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), (
        F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_range")).alias("before"))
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(before, dealt.source.eqNullSafe(before.s) & (dealt.range == before.r)).withColumn(
        "start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    budget = F.floor(F.col("target") + 0.5)
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - rounds * F.col("source_size") - F.col("start")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (rounds * F.col("size") + F.least("size", F.greatest(F.lit(0), rest))).cast("long").alias("taken"), *[f"`c_{c}`" for c in carry])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  substr(md5('42:' || doc_id::VARCHAR), 1, 13) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM r),
v AS (SELECT min_by(here, ratio) AS lev FROM (SELECT * FROM l WHERE ratio >= here)),
t AS (SELECT source, source_size, coalesce(least(cap, lev * weight), cap) AS target FROM l, v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(size, greatest(0, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM c
"""
