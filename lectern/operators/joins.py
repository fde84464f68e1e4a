"""Joins and numbering that stay even when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import scratch_folder

SPREAD = 16
_SALT = "__salt"


def join_per_key(
    rows: DataFrame, per_key: DataFrame, key: str, spread_by: Column, how: str = "left",
) -> DataFrame:
    """Join ``rows`` to a table with at most one row per ``key``.

    ``spread_by`` is any column of ``rows`` that varies within a key.  It cuts
    each key into ``SPREAD`` parts, and the one-row side is repeated for each
    part, so a key that holds a third of all rows still goes to many tasks.  If
    the one-row side is small, Spark broadcasts it by its own size check.
    """
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    return salted.join(per_key.withColumn(_SALT, parts), [key, _SALT], how).drop(_SALT)


def number_within(rows: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """Add ``number``: the 1-based position of each row in its group.

    Rows are dealt out by ranges of (group, order) taken from the data, so a large
    group lies in many tasks, whatever its keys look like.  Each row gets its place
    in its range; what comes before it in the group is known from the first place
    and the size of the group in each range, a table of about one row per group.
    The ranged rows are written to the shared folder, so that places are counted
    once.  Rows of one group and order are numbered in any order.
    """
    ranged = rows.repartitionByRange(group, order).sortWithinPartitions(group, order)
    placed = ranged.withColumn("__id", F.monotonically_increasing_id())
    folder = scratch_folder(rows.sparkSession, "numbered")
    placed.write.parquet(folder)
    # The upper bits of the id are the number of the range, the lower ones the place.
    table = rows.sparkSession.read.schema(placed.schema).parquet(folder)
    table = table.withColumn("__range", F.shiftright("__id", 33))
    parts = table.groupBy(group, "__range").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__size")
    )
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__size").over(earlier), F.lit(0))
    shifts = parts.select(
        F.col(group).alias("__group"), F.col("__range").alias("__part"), (before - F.col("__first") + 1).alias("__shift")
    )
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__part"))
    numbered = table.join(shifts, same).withColumn(number, F.col("__id") + F.col("__shift"))
    return numbered.select(*rows.columns, number)
