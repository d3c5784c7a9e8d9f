import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetlens.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = configure(
        SparkSession.builder.master("local[8]").appName("tests"),
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"},
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column function over a list of values of one column named ``x``."""

    def evaluate(function, values, dtype="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
        return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]

    return evaluate
