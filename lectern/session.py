"""Session settings the library is tuned for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Bytes of files up to which a table is dealt out to all cores.
SMALL_BYTES = 256 << 20
SETTINGS = {
    # Re-plan at run time: coalesce small partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Archives and pages are large rows: bound what crosses to Python at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`SETTINGS` to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of the session.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  Where that is
    unset a temporary folder will do on a single machine; on a cluster every
    executor would write to its own disk, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lectern-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that it is worked out once."""
    folder = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table for row-by-row text work on all cores.

    Only a table of at most ``SMALL_BYTES``, which may lie in a single row group, is
    dealt out to all cores.  Any other table is read as it lies, without a
    shuffle, however many cores there are.
    """
    table = spark.read.parquet(path)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_BYTES else table
