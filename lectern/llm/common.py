"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lectern.session import scratch_folder

# Texts are handed to the per-task code in slices of about this many bytes, so
# the working memory of a task does not depend on how long documents are.
SLICE_BYTES = 4 << 20


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder of the session and read it back.

    Cuts the lineage with files that every executor can read again.
    """
    folder = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def row_hash(docs: DataFrame) -> list[Column]:
    """128 bits of hash of a whole row, as two longs; equal rows have equal hashes.

    Operators that take decisions by id can then decide on rows, whatever ids are null or repeat.
    """
    plain = [
        F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
        for f in docs.schema.fields
    ]
    # A null leaves the hash as it is, so its place is hashed too.
    nulls = F.concat(*(c.isNull().cast("string") for c in plain))
    return [F.xxhash64(nulls, *plain).alias("hash0"), F.xxhash64(F.lit(1), nulls, *plain).alias("hash1")]


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """The named Parquet tables of a folder."""
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]


def sample_of(frame: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` rows of ``frame``, which has about ``total``: those of smallest hash.

    Hashes above the share that is wanted, with a margin, are left out first, so
    the tasks together send about ``rows`` rows to the driver, however many they are.
    """
    share = min(1.0, (1.1 * rows + 1000) / max(total, 1))
    hashed = F.xxhash64(key)
    if share < 1:
        frame = frame.filter(F.pmod(hashed, F.lit(1 << 40)) < int(share * (1 << 40)))
    return frame.orderBy(F.pmod(hashed, F.lit(1 << 40)), *frame.columns).limit(rows)


def slices(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``text``.

    A single longer text makes a slice of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [value or "" for value in batch.column(text).to_pylist()]


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def without_gc(function: Batches) -> Batches:
    """Run a batch function without the cycle collector.

    Functions that make millions of strings and lists without cycles spend a
    third of their time in it; reference counts free all of these anyway.
    """

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was_on = gc.isenabled()
        gc.disable()
        try:
            yield from function(batches)
        finally:
            if was_on:
                gc.enable()

    return run
