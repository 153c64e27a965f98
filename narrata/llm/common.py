"""Shared helpers: tables in the shared folder, Arrow mapping, bounded bitmaps, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.shipping import shared_base, ship, slices

#: Lower-cases A-Z only, on UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: White space that separates words: bytes.split() without arguments splits on exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Rows of an Arrow batch: texts are long, so far fewer than Spark's default.
BATCH_ROWS = "2500"


def prepare(spark: SparkSession) -> None:
    """Ships the package and keeps Arrow batches small, unless the session sets their size."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the application ends.

    Only where that setting is absent (tests on one machine) a local folder is used.
    """
    prepare(spark)
    folder = f"{shared_base(spark)}/{uuid.uuid4().hex}"
    files, path = _files(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)  # results are read until the application ends
    return folder


def _files(spark: SparkSession, name: str):
    """The Hadoop file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table into the shared folder and reads it back.

    The files outlive any executor, so this is how lineage is cut.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, folder: str) -> DataFrame:
    """(row, doc): the rows of ``docs`` as structs, with numbers that hold however often the table is read.

    Rows of a Parquet table are numbered by file and place; any other table is
    written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "_metadata" in docs.columns or not docs.inputFiles()[0:1]:
        return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), folder, "rows")
    path = F.col("_metadata.file_path")
    files = stored(docs.select(path.alias("file")).distinct().withColumn("f", F.row_number().over(Window.orderBy("file"))), folder, "files")  # a row per file
    rows = docs.select(path.alias("file"), F.col("_metadata.row_index").alias("at"), F.struct("*").alias("doc")).join(files, "file")
    return rows.select(F.shiftleft(F.col("f").cast("long"), 40).bitwiseOR(F.col("at")).alias("row"), "doc")


def dropped(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables that later steps no longer read."""
    for name in names:
        files, path = _files(spark, f"{folder}/{name}")
        files.delete(path, True)


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, column: str, most_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow over bounded slices of each batch; memory stays bounded whatever the text lengths are."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most_bytes):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Bits of a bitmap, at least and at most (128 MB); between, 32 to 64 for each value.
BITMAP_BITS = 1 << 20, 1 << 30


def bitmap_of(df: DataFrame, col: str) -> np.ndarray:
    """A bitmap of a power of two of bits, by the table's size: set where a well-mixed long column's low bits point.

    It is built on the executors; rows of 4 KB come to the driver, 128 MB at
    most.  As a prefilter it only saves work: what passes is joined exactly
    afterwards, also where a table of over 2**30 values fills it.
    """
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (32 * df.count()).bit_length()))
    pos = F.col(col).bitwiseAND(F.lit(bits - 1))
    rows = (
        df.filter(F.col(col).isNotNull())
        .select(F.shiftrightunsigned(pos, 15).cast("int").alias("b"), pos.bitwiseAND(F.lit(32767)).alias("p"))
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    ).toArrow()
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for b, m in zip(rows["b"].to_pylist(), rows["m"].to_pylist()):
        out[b] = np.frombuffer(m, np.uint8)
    return out.reshape(-1)


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the int64 ``values`` may be in the bitmap (no false negatives)."""
    pos = values.view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1


def connected_components(edges: DataFrame, folder: str, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Each round takes the least label among a vertex's neighbours (combined
    before the shuffle) and then jumps to the label's own label, so long chains
    halve.  Every round is a table in the shared folder.  Raises if it does not
    converge.
    """
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), folder, f"{name}_edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), folder, f"{name}_0")
    for i in range(1, most_rounds):
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("m"))
        best = labels.join(near, labels.v == near.a, "left").select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("v").alias("u"), F.col("root").alias("above"))
        new = best.join(up, best.root == up.u, "left").select("v", "old", F.least("root", "above").alias("root"))
        new = stored(new, folder, f"{name}_{i}")
        changed = new.filter("old <> root").limit(1).count()
        labels = new.select("v", "root")
        if i > 1:
            dropped(spark, folder, f"{name}_{i - 2}")
        if not changed:
            return labels
    raise RuntimeError("connected components did not converge")
