"""Sums of the sample panels, which must not depend on the order that rows come in."""

import random

import pytest
from pyspark.sql import functions as F

from panelwright.plans.fixtures import Fixtures, total
from panelwright.sources import panels

NAN, INF = float("nan"), float("inf")


def test_panels_of_rows_in_another_order_are_equal(spark, tmp_path):
    """What an exchange does to rows on a cluster, done by hand: last digits of a plain sum depend on it."""
    rng = random.Random(5)
    rows = [(f"2024-01-{1 + n % 9:02d}", f"{n % 3}", round(rng.uniform(1000, 500_000), 2)) for n in range(5400)]
    made = []
    for name in ("one", "two"):
        table = spark.createDataFrame(rows, "d string, o_orderpriority string, o_totalprice double").withColumn("o_orderdate", F.col("d").cast("timestamp"))
        table.coalesce(1).write.parquet(str(tmp_path / name / "orders.parquet"))
        made.append(Fixtures(spark, str(tmp_path / name)).ord_d)
        rng.shuffle(rows)
    assert made[0].count() == 27
    assert panels.equal_panels(*made)


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([0.1, 0.2, 0.3], 0.6),
        ([0.3, None, 0.2, 0.1], 0.6),
        ([None], None),
        ([1e10, -1e10, 0.25], 0.25),
        ([1e300, 1.0], 1e300),
        ([1e-30, 2e-30], 3e-30),
        ([1.0, INF], INF),
        ([1.0, NAN], NAN),
    ],
)
def test_total(spark, values, want):
    got = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).agg(total("x")).first()[0]
    assert got == (pytest.approx(want, rel=1e-15, nan_ok=True) if want in (3e-30,) or want != want else want)
