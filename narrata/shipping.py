"""What driver and executors share: this package, and a folder; and batches cut to a size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as an archive, once per application; workers then import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    if not package.is_dir():
        return  # it runs from an archive that was shipped already
    archive = Path(_temporary()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))


def _temporary() -> str:
    """A folder of this machine that goes when the driver ends."""
    folder = tempfile.mkdtemp(prefix="narrata-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only on one machine, where that is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _temporary()
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The table as it is now, checkpointed to the shared folder: what costs requests or is read often is worked out once."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a record batch into runs of rows whose ``column`` holds about ``most_bytes`` (a row at least)."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
