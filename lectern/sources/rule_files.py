"""Read rule files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_rule_file(spark: SparkSession, path: str) -> DataFrame:
    """The file as one row ``value``; a missing file is an empty table.

    Order decides the result and a line source numbers no lines, so the file is
    read whole.
    """
    try:
        return spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], "value string")
