"""Streams against the batch operators, a few rows at a time."""

import numpy as np
from pyspark.sql import functions as F

from panelwright import operators as op
from panelwright.functions.columns import by_date
from panelwright.streaming import stream_band, stream_ewm
from tests.test_naive import gappy, lists


def run(spark, panel, tmp_path, build, name):
    """Each third of the dates is a file, and a micro-batch."""
    days = [r[0] for r in panel.select("date").distinct().orderBy("date").collect()]
    for i in range(3):
        some = days[i * len(days) // 3 : (i + 1) * len(days) // 3]
        panel.where(F.col("date").isin(some)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return {(r.date, r.asset): r.value for r in spark.table(name).collect()}


def compare(got, want):
    want = {(r.date, r.asset): r.value for r in want.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        g = None if got[k] is None or np.isnan(got[k]) else got[k]
        assert (g is None) == (v is None)
        assert v is None or abs(g - v) < 1e-12


def test_ewm(spark, panel, tmp_path):
    p = panel(lists(gappy(81, rows=9, cols=3)))
    compare(run(spark, p, tmp_path, lambda s: stream_ewm(s, 2), "ewm"), op.ewm_mean(p, 2))


def test_band(spark, panel, tmp_path):
    p = panel(lists(gappy(82, rows=9, cols=3)))
    scaled = p.withColumn("scale", F.avg(F.abs("value")).over(by_date()))
    compare(run(spark, scaled, tmp_path, lambda s: stream_band(s, 0.6), "band"), op.no_trade_band(p, 0.6))
