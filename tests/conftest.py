import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lectern.session import tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        tuned(SparkSession.builder.master("local[4]"))
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a column function to a list of strings, in order."""
    from pyspark.sql import functions as F

    def run(function, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
        return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
