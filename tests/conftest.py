import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


NAN = float("nan")


@pytest.fixture(scope="session")
def panel(spark):
    """Panel from rows of values, with None for a gap; assets a, b, c, ..., dates a day apart."""
    from datetime import datetime, timedelta

    from panelwright.sources import panels

    def make(rows, assets=None, start=datetime(2024, 1, 1), step=timedelta(days=1)):
        n = len(rows[0]) if rows else 0
        return panels.from_rows(spark, [start + i * step for i in range(len(rows))], assets or [chr(97 + i) for i in range(n)], rows)

    return make


@pytest.fixture(scope="session")
def series(spark):
    """Series from values, dates a day apart."""
    from datetime import datetime, timedelta

    from panelwright.sources import panels

    def make(values):
        rows = [(str(datetime(2024, 1, 1) + timedelta(days=i)), None if v is None else float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "d string, value double")
        return panels.sanitize(df.selectExpr("cast(d as timestamp_ntz) as date", "value"))

    return make


@pytest.fixture(scope="session")
def rows():
    """Rows of values of a panel (or a flag column), by date and asset; a list for a series."""

    def take(df, column="value"):
        column = column if column in df.columns else "flag"
        if "asset" not in df.columns:
            return [r[column] for r in df.orderBy("date").collect()]
        out = {}
        for r in df.collect():
            out.setdefault(r["date"], {})[r["asset"]] = r[column]
        return [[out[d][a] for a in sorted(out[d])] for d in sorted(out)]

    return take
