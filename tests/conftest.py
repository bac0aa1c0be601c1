import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from affectframe import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Values of a column expression over a list of inputs, in order."""

    def run(values, expression, kind="string"):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        rows = frame.select("i", expression(F.col("v")).alias("out")).collect()
        return [row.out for row in sorted(rows, key=lambda r: r.i)]

    return run
