"""Exact duplicates: an extendible-hash index of texts in shared files (DataFrame functions only).

Texts are equal when their white-space-normalised forms are.

1. Every row's hash (64 bits), digest and id go into a table without texts.
2. Directory.  It is laid out at the depth at which an even hash fills its
   buckets; a bucket is a prefix of the hash.  A bucket with more than
   ``capacity`` distinct hashes splits into two of one bit more, again and
   again: there is no last depth but the hash's own 64 bits.
3. Only hashes that several rows share need their texts compared.  Copies of one
   text combine within their task first (a list of the rows, bounded by the
   task's input), so a group that holds a third of all rows goes on as one row a
   task.
4. Owner tasks hold ranges of buckets.  Within a bucket the entries of one hash
   are its chain, ordered by their bytes: neighbours with equal bytes are one
   text, others are collisions and stay apart.  What the owners find is the index,
   written in bucket order; the verdicts are read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import SPACE_CLASS

#: Distinct hashes in a bucket.
CAPACITY = 4096
#: Bits of the bitmap that keeps texts of lone hashes where they are (32 MB).
MOST_BITS = 1 << 28


def normalised(col: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), SPACE_CLASS + "+", " ")


def _prefix(depth: int) -> Column:
    """A hash without all but its first ``depth`` bits."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftleft(F.shiftright("h", 64 - depth), 64 - depth)


def directory(hashes: DataFrame, folder: str, capacity: int = CAPACITY, depth: int = 0) -> DataFrame:
    """(h, depth, bucket) for each of the distinct ``hashes(h, ...)``, with their other columns; from ``depth`` on, overfull buckets split."""
    rest = [c for c in hashes.columns if c != "h"]
    levels, open_ = [], hashes
    while True:
        placed = open_.withColumn("bucket", _prefix(depth)).withColumn("in_bucket", F.count("*").over(Window.partitionBy("bucket")))
        placed = common.stored(placed, folder, f"depth_{depth}")
        full = (F.col("in_bucket") > capacity) & F.lit(depth < 64)
        levels.append(placed.filter(~full).select("h", F.lit(depth).alias("depth"), "bucket", *rest))
        open_ = placed.filter(full).select("h", *rest)
        if open_.isEmpty():
            break
        depth += 1
    out = levels[0]
    for level in levels[1:]:
        out = out.unionAll(level)
    return out


def probably_in(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The ``rows`` whose ``h`` may be among ``hashes``: all that are, and few others.

    A bitmap of 32 to 64 bits a hash, ``MOST_BITS`` at most, is broadcast in
    rows of 4 KB; what passes is joined exactly afterwards, also where the
    bitmap is full.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (32 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    block, at = F.shiftrightunsigned(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    bitmap = hashes.select(block.alias("block"), at.alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("block", block).join(F.broadcast(bitmap), "block")  # MOST_BITS at most
    return joined.filter(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("block", "map")


def build_index(docs: DataFrame, folder: str, carry: tuple[str, ...] = (), capacity: int = CAPACITY, depth: int | None = None, hashed: Column | None = None) -> DataFrame:
    """The index table (bucket, depth, h, chain, sha, keep, n, members): equal entries of a chain position are one text.

    ``members``: the rows, as structs (doc_id, carried columns); ``keep``: the
    one that stays, as (no id, doc_id, carried columns).
    """
    member = F.struct(F.col("doc_id"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry])
    h = F.xxhash64("norm") if hashed is None else hashed
    rows = docs.select(member.alias("member"), normalised().alias("norm")).withColumn("h", h)
    keyed = common.stored(rows.select("member", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), folder, "keyed")
    if depth is None:  # where an even hash would fill the buckets
        depth = (keyed.agg(F.approx_count_distinct("h")).first()[0] // capacity).bit_length()
    cells = directory(keyed.groupBy("h").agg(F.count("*").alias("rows")), folder, capacity, depth)

    lone = F.struct(F.col("member.doc_id").isNull().alias("no_id"), F.col("member.*"))
    alone = keyed.join(cells.filter("rows = 1").drop("rows"), "h").select(
        "bucket", "depth", "h", F.lit("").alias("norm"), "sha", lone.alias("keep"), F.lit(1).cast("long").alias("n"), F.array("member").alias("members"))
    # Texts travel for shared hashes only; a task's copies of a text are one row.  The key is a struct, so that the
    # grouping does not build on the join's partitioning by hash: adaptive execution may then split a hot hash.
    shared = cells.filter("rows > 1").drop("rows")
    several = probably_in(rows, shared).join(shared, "h").groupBy(F.struct("bucket", "depth", "h").alias("cell"), "norm", F.spark_partition_id().alias("task")).agg(
        F.min(lone).alias("keep"), F.count("*").alias("n"), F.collect_list("member").alias("members"))
    several = several.select("cell.*", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "n", "members")
    entries = alone.unionByName(several)

    # A task owns ranges of the hash, some to a task, as buckets begin evenly over it; no sample is needed to lay them out.
    ranges = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.withColumn("owner", F.floor(F.shiftrightunsigned("bucket", 33) / F.lit(float(1 << 31)) * F.lit(ranges)).cast("int"))
    equal, chain = Window.partitionBy("owner", "bucket", "h", "norm"), Window.partitionBy("owner", "bucket", "h").orderBy("norm")
    owned = entries.repartition("owner").select(
        "bucket", "depth", "h", F.dense_rank().over(chain).alias("chain"), "sha", F.min("keep").over(equal).alias("keep"), F.sum("n").over(equal).alias("n"), "members")
    return common.stored(owned, folder, "index")


def exact_duplicates(docs: DataFrame, carry: tuple[str, ...] = (), capacity: int = CAPACITY, depth: int | None = None, hashed: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, stays): one row per row of ``docs``, with the columns ``carry`` as c_<name>.

    Of equal texts the row with the smallest doc_id is kept.  Null and empty
    texts are equal to each other; text of white space only becomes one space.
    Rows that repeat a doc_id and a text are kept or not together; ``stays`` is
    true for those whose carried columns are the least, too, so it is true for
    one row of a group if a row number is carried.  A null doc_id yields to any
    other and is kept only where its whole group has none.  Texts of any length
    are compared whole.  Other columns are ignored, whatever their names.  An
    empty table gives an empty result.
    """
    folder = common.shared_dir(docs.sparkSession)
    index = build_index(docs, folder, carry, capacity, depth, hashed).select(F.inline("members"), "keep", "n", "sha")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *[f"`c_{c}`" for c in carry])
    return index.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        own.eqNullSafe(F.col("keep")).alias("stays"), *[f"`c_{c}`" for c in carry])


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
