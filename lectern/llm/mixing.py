"""Mix sources to target weights by hash-threshold histograms.

Every row gets a hash, read as a number in digits.  Words are summed by source and
first digit; the running sum of that histogram says in which digit a source's budget
ends.  All rows below that digit are in, all above are out, and only rows in this
boundary bucket are looked at again, by their next digit, until it holds one row.
So a budget becomes a threshold on the hash: the rows are never sorted, and a larger
budget takes all rows that a smaller one takes.  A target above the size of a source
is whole passes over it and one budget for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import slices, written

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
DIGIT_BITS = 12
# A hash is five digits of text and id, then five digits that tell equal rows apart.
KEY_DIGITS = 5
KEY_BITS = DIGIT_BITS * KEY_DIGITS
_SOURCE = ["unnamed", "source"]


def word_counts(column: pa.Array) -> np.ndarray:
    """Runs of bytes other than space and U+0009 to U+000D in each text; 0 for null."""
    column = column.cast(pa.large_binary())
    # Null rows may have any offsets; filled ones are empty.
    column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    if ends[-1] == ends[0]:
        return np.zeros(len(column), np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[1:] > ends[:-1]]
    begins[starts] = inside[starts]
    seen = np.concatenate([[0], np.cumsum(begins)])
    return seen[ends[1:]] - seen[ends[:-1]]


def sizes(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, unnamed, source, size, k0, k1`` per row; map-only.

    ``k0`` is a hash of id and text, ``k1`` one of the row number, which only
    decides between rows of equal id and text.
    """
    body = F.col(text)
    hashed = lambda *of: F.shiftrightunsigned(F.xxhash64(*of), 64 - KEY_BITS)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(source).isNull().alias("unnamed"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), body.alias("body"),
        hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), body).alias("k0"),
        hashed(F.monotonically_increasing_id()).alias("k1"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            size = pa.array(word_counts(batch.column("body")))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns("body").columns, size], [*names, "size"])

    names = ["doc_id", *_SOURCE, "k0", "k1"]
    return rows.mapInArrow(run, "doc_id long, unnamed boolean, source string, k0 long, k1 long, size long")


def _ranked(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Add ``weight`` by the place of each source in code point order, null last.

    Places are counted in ranges of the data; the driver gets one count a range.
    """
    ranged = sources.repartitionByRange(*_SOURCE).sortWithinPartitions(*_SOURCE)
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, shifts = 0, []
    for row in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        shifts.append((row.part, before % len(weights)))
        before += row.n
    moved = F.create_map(*[F.lit(x).cast("long") for pair in shifts for x in pair])[part] if shifts else F.lit(0)
    return placed.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(moved + place, F.lit(len(weights))).cast("int")])


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add ``weight`` and ``target`` to a table of sources with their ``source_size``.

    All sizes are shared by weight; a target stops at ``repeats`` times its source's
    size, and what is over is shared among the others until none is above.  Each
    round is one aggregation, and only its sums reach the driver.
    """
    rows = written(_ranked(sources, weights), "weights")
    most = F.col("source_size") * float(repeats)
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = -1.0, None
    while True:
        # A source is full once the level, words per unit of weight, reaches its bound.
        full = most <= level * F.col("weight")
        sums = rows.agg(
            F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.count(F.when(full, 1)),
        ).first()
        if sums[2] == capped or not sums[1]:
            break
        capped, level = sums[2], (whole - sums[0]) / sums[1]
    return rows.select(*_SOURCE, "source_size", F.least(most, F.col("weight") * max(level, 0.0)).alias("target"))


def _digit(level: int) -> Column:
    """Digit ``level`` of the hash: of ``k0``, then of ``k1``."""
    name, place = ("k0", level) if level < KEY_DIGITS else ("k1", level - KEY_DIGITS)
    shift = KEY_BITS - DIGIT_BITS * (place + 1)
    return F.shiftright(name, shift).bitwiseAND((1 << DIGIT_BITS) - 1)


def _histogram(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy(*_SOURCE, _digit(level).alias("digit")).agg(
        F.sum("size").alias("held"), F.count(F.lit(1)).alias("n")
    )


def _boundaries(counted: DataFrame) -> DataFrame:
    """The bucket of each source in which its ``budget`` ends, and the words ``below`` it.

    A window sees one source's buckets, of which there are ``2 ** DIGIT_BITS`` at most.
    """
    order = Window.partitionBy(*_SOURCE).orderBy("digit")
    upto = counted.withColumn("below", F.sum("held").over(order) - F.col("held"))
    inside = (F.col("below") < F.col("budget")) & (F.col("below") + F.col("held") >= F.col("budget"))
    return upto.filter(inside).withColumn("budget", F.col("budget") - F.col("below")).drop("below")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``unnamed, source, t0, t1``: rows whose ``(k0, k1)`` is smaller are in the budget.

    ``budgets`` has one ``budget`` for each source; sources of budget 0 have no row in
    the result.  The words taken are the sum nearest to the budget that any threshold
    gives, one row more or less than the budget.
    """
    found, left = None, rows.filter("size > 0")
    positive = written(budgets.filter("budget > 0").select(*_SOURCE, "budget"), "budgets")
    for level in range(2 * KEY_DIGITS):
        counted = _histogram(left, level).join(positive, _SOURCE)
        ends = written(_boundaries(counted), "boundaries")
        joined = left.join(ends.withColumnRenamed("digit", "at"), [*_SOURCE]) if level else None
        # The first cut is by source and digit, so a source with most rows goes to many tasks.
        if joined is None:
            joined = left.withColumn("at", _digit(0)).join(ends.withColumnRenamed("digit", "at"), [*_SOURCE, "at"])
        inner = joined.filter(_digit(level) == F.col("at"))
        last = level == 2 * KEY_DIGITS - 1
        # Buckets of one row are settled: it is in if that is nearer to the budget.
        done = inner.filter("n = 1" if not last else "true").select(
            *_SOURCE, "k0", (F.col("k1") + F.when(2 * F.col("budget") > F.col("held"), 1).otherwise(0)).alias("t1")
        )
        done = written(done.groupBy(*_SOURCE).agg(F.max("k0").alias("t0"), F.max("t1").alias("t1")), "settled")
        found = done if found is None else found.unionByName(done)
        left = written(inner.filter("n > 1").select(*_SOURCE, "k0", "k1", "size"), "boundary-rows")
        positive = ends.filter("n > 1").select(*_SOURCE, "budget")
        if last or left.isEmpty():
            return found


def mix(
    docs: DataFrame, text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row.

    ``size`` counts the words of the whole text, however long; null and empty texts
    have none and are never taken.  Sources stand in code point order, the null
    source last; ``weights`` go round.  ``taken`` is the size times the passes over
    the row, ``repeats`` at most; the words taken of a source differ from its target
    by half of one row at most.  Null ids and repeated rows count row by row; which of
    rows with equal id and text are taken is open, how many is not, so reruns agree.
    Hash ties between different rows are broken by their row number.  An empty table
    gives no rows; other columns are left out.
    """
    rows = written(sizes(docs, text, source), "sizes")
    digit = _digit(0).alias("digit")
    by_digit = written(_histogram(rows, 0), "histogram")
    sources = by_digit.groupBy(*_SOURCE).agg(F.sum("held").alias("source_size"))
    aims = written(targets(sources, weights, repeats), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("passes", F.least(passes, F.lit(repeats)))
    over = F.when(F.col("passes") < repeats, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)
    ends = thresholds(rows, aims.select(*_SOURCE, over.alias("budget")))
    plan = aims.join(ends, _SOURCE, "left")
    # One plan row for each source and first digit that occurs: a source with most rows is spread.
    spread = by_digit.select(*_SOURCE, "digit").join(plan, _SOURCE)
    mine = (F.col("k0") < F.col("t0")) | ((F.col("k0") == F.col("t0")) & (F.col("k1") < F.col("t1")))
    again = F.when(F.coalesce(mine, F.lit(False)), 1).otherwise(0)
    joined = rows.withColumn("digit", digit).join(spread, [*_SOURCE, "digit"])
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + again)).alias("taken")
    )
