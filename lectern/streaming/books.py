"""Convert books and pages as they arrive, each once.

All steps work row by row, so the streams keep no state and need no watermark:
the checkpoint remembers which files were read.  A file is taken once per path;
a book written again under the same path is not converted again.  Of a stream with a
table of arrivals it remembers lots of files, and the driver holds no list of files.

``ingest_archives`` opens every archive once and appends what it holds to one
table; chapters, books, contents and rejects are the same views of that table as
in a batch run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lectern.functions.rule_dialect import Rule
from lectern.plans.chapters import chapters_of_archives, observed, with_texts
from lectern.sources import epub, listing, outputs

# Bytes of archives in one micro-batch, so that the first one is not the whole collection.
BATCH_BYTES = 64 << 30
# For streams of many small files: a micro-batch lists its files again, by so many tasks for
# each core instead of 10,000, and a task takes more of them than 4 MB a file would allow.
LISTING_TASKS = 4
OPEN_BYTES = 256 << 10
# For streams of lots, more than a task takes: each lot is a task.
LOT_OPEN_BYTES = 1 << 40
ARRIVED = "path string, length long"
BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


@contextmanager
def small_files(spark: SparkSession, open_bytes: int = OPEN_BYTES) -> Iterator[None]:
    """Settings of the session while streams of many small files run.

    ``open_bytes`` is ``LOT_OPEN_BYTES`` for streams with a table of arrivals.
    """
    wanted = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": LISTING_TASKS * spark.sparkContext.defaultParallelism,
        "spark.sql.files.openCostInBytes": open_bytes,
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def file_stream(
    spark: SparkSession, folder: str, batch_bytes: int = BATCH_BYTES, arrivals: str = "",
) -> DataFrame:
    """New archives in ``folder`` and all folders below it.

    A micro-batch takes files of up to ``batch_bytes`` in all, and one file at least.  See
    ``small_files`` for many small ones.

    Spark's file source keeps every file it has seen on the driver.  With ``arrivals``, a folder that
    belongs to the stream as its checkpoint does, executors list ``folder``, by its letters,
    and append what is new to a table there; the stream takes ``path, length`` from that table, lot by
    lot, so that the driver and the checkpoint hold lots.  A micro-batch takes lots of up to about
    ``batch_bytes``, and one lot at least.
    """
    if arrivals:
        lot = min(epub.TASK_BYTES, batch_bytes)
        _announce(spark, folder, arrivals, lot)
        lots = spark.readStream.schema(ARRIVED).option("maxFilesPerTrigger", batch_bytes // lot)
        return lots.parquet(arrivals)
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    reader = reader.option("recursiveFileLookup", "true").option("maxBytesPerTrigger", batch_bytes)
    return reader.load(folder).filter(epub.is_archive(F.col("path"), []))


def _announced(spark: SparkSession, arrivals: str) -> DataFrame | None:
    """The table of arrivals, if there is one yet."""
    try:
        return spark.read.schema(ARRIVED).parquet(arrivals)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _announce(spark: SparkSession, folder: str, arrivals: str, lot_bytes: int) -> None:
    """Append the archives below ``folder`` that ``arrivals`` does not name, each lot a file.

    What a run that failed has appended is named there, so no archive is in two lots.
    """
    files, lost = listing.resolve(spark, folder)
    unlisted = lost.filter(F.col("reason") != listing.EMPTY).first()
    if unlisted is not None:
        raise OSError(f"{unlisted.path}: {unlisted.reason}")
    known = _announced(spark, arrivals)
    new = files if known is None else files.join(known, "path", "left_anti")
    size, count = new.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    if count or known is None:
        lots = -(-(size + count * outputs.OPEN_BYTES) // lot_bytes)
        lots = min(max(spark.sparkContext.defaultParallelism, lots), max(count, 1))
        new.repartition(lots).write.mode("append").parquet(arrivals)


def archive_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New archives below ``folder`` as ``(path, content)`` rows."""
    return epub.readable(file_stream(spark, folder))


def page_stream(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """New Parquet files with HTML pages; ``folder`` may be a pattern, which finds folders and single files."""
    return spark.readStream.schema(PAGES).option("pathGlobFilter", glob).parquet(folder)


def _sink(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class Progress(StreamingQueryListener):
    """The progress figures of a stream of chapters, added up over its micro-batches.

    Register it with ``spark.streams.addListener``; ``figures`` are those that
    ``plans.chapters.observed`` names, under the name the stream was given.
    """

    def __init__(self, name: str) -> None:
        self.name, self.batches = name, 0
        self.figures: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches += 1
            for figure, value in seen.asDict().items():
                self.figures[figure] = self.figures.get(figure, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def convert_archives(
    archives: DataFrame, folder: str, checkpoint: str, rules: Sequence[Rule] = (), progress: str = "",
) -> StreamingQuery:
    """Write the chapter table of all archives that have arrived.

    ``progress`` names the figures that a ``Progress`` listener adds up.
    """
    chapters = chapters_of_archives(epub.unpack(archives), rules)
    return _sink(observed(chapters, progress) if progress else chapters, folder, checkpoint)


def ingest_archives(files: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append all archives that have arrived to the unpacked table in ``folder``.

    Each archive is opened once, by its path, and may be of any length; see
    ``epub.books``, ``epub.chapters`` and ``epub.rejects`` for what is read off the
    table (``unpacked_table``).
    """
    return _sink(epub.unpack_listed(files), folder, checkpoint)


def unpacked_table(spark: SparkSession, folder: str) -> DataFrame:
    """What ``ingest_archives`` has written so far, without books found damaged late."""
    return epub.settled(spark.read.schema(epub.UNPACKED).parquet(folder))


def convert_pages(
    pages: DataFrame, folder: str, checkpoint: str, rules: Sequence[Rule] = (),
) -> StreamingQuery:
    """Write the text of all pages that have arrived."""
    return _sink(with_texts(pages, rules), folder, checkpoint)
