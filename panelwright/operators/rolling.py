"""Trailing windows of rows, answered from min_periods present cells on.

Windows count the rows of the dense panel, gaps included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import anchored, at_least, by_asset, ratio, trailing, v, window_of, with_moments
from ..panel import ASSET, DATE, VALUE
from ..sources.panels import pair


def _row() -> Column:
    return F.row_number().over(by_asset())


def windowed(panel: DataFrame, window: int) -> DataFrame:
    """(date, asset, slot, value): the window of each row, slot 0 its oldest; NULL before the first row."""
    at_least("window", window, 1)
    # the frame once, its gaps kept by a struct for each row; before the first row it is shorter
    seen = panel.select(DATE, ASSET, F.collect_list(F.struct(v())).over(trailing(window)).alias("_seen"))
    blank = F.array_repeat(F.struct(F.lit(None).cast("double").alias(VALUE)), F.lit(window) - F.size("_seen"))
    return seen.select(DATE, ASSET, F.posexplode(F.concat(blank, "_seen")).alias("slot", "_cell")).select(DATE, ASSET, "slot", F.col(f"_cell.{VALUE}").alias(VALUE))


def partial_rolling_mean(panel: DataFrame, window: int, min_periods: int) -> DataFrame:
    """Mean of the present cells."""
    window_of(window, min_periods)
    rows = with_moments(panel.select(DATE, ASSET, VALUE), v(), window)
    return rows.select(DATE, ASSET, F.when(F.col("n") >= min_periods, F.col("total") / F.col("n")).alias(VALUE))


def partial_rolling_std(panel: DataFrame, window: int, min_periods: int, *, ddof: int = 1) -> DataFrame:
    """Standard deviation of the present cells; NULL where it is 0 and for ddof cells or fewer."""
    least = max(min_periods, ddof + 1)
    window_of(window, min_periods)
    window_of(window, least)
    rows = with_moments(panel.select(DATE, ASSET, anchored(v()).alias(VALUE)), v(), window)
    deviation = F.sqrt(ratio(F.col("spread"), F.col("n").cast("double") - ddof))
    return rows.select(DATE, ASSET, F.when((F.col("n") >= least) & (F.col("most") > F.col("least")) & (deviation > 0), deviation).alias(VALUE))


def rolling_extreme(panel: DataFrame, window: int, min_periods: int, *, lowest: bool) -> DataFrame:
    """Smallest or largest of the present cells."""
    window_of(window, min_periods)
    rows = with_moments(panel.select(DATE, ASSET, VALUE), v(), window)
    return rows.select(DATE, ASSET, F.when(F.col("n") >= min_periods, F.col("least" if lowest else "most")).alias(VALUE))


def bars_since_extreme(panel: DataFrame, window: int, min_periods: int, *, lowest: bool) -> DataFrame:
    """Rows since the smallest or largest present cell, the oldest of equal ones."""
    window_of(window, min_periods)
    w = trailing(window)
    rows = panel.withColumn("_row", _row().cast("double"))
    if lowest:
        at = F.min(F.when(v().isNotNull(), F.struct(v(), F.col("_row").alias("r")))).over(w)["r"]
    else:
        at = -F.max(F.when(v().isNotNull(), F.struct(v(), (-F.col("_row")).alias("r")))).over(w)["r"]
    return rows.select(DATE, ASSET, F.when(F.count(v()).over(w) >= min_periods, F.col("_row") - at).alias(VALUE))


def rolling_correlation(left: DataFrame, right: DataFrame, window: int, min_periods: int) -> DataFrame:
    """Correlation of the cells that both sides have; NULL where one side does not vary.  right may be a series."""
    window_of(window, min_periods)
    w = trailing(window)
    both = pair(left, right, ("x", "y"))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    both = both.select(DATE, ASSET, F.when(ok, F.col("x")).alias("x"), F.when(ok, F.col("y")).alias("y"))
    both = both.select(DATE, ASSET, anchored(F.col("x")).alias("x"), anchored(F.col("y")).alias("y"))
    varies = (F.max("x").over(w) > F.min("x").over(w)) & (F.max("y").over(w) > F.min("y").over(w))
    r = ratio(F.covar_pop("x", "y").over(w), F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w))
    return both.select(DATE, ASSET, F.when((F.count("x").over(w) >= min_periods) & varies, r).alias(VALUE))


def rolling_slope(panel: DataFrame, window: int, min_periods: int) -> DataFrame:
    """Least-squares slope of the present cells on the row number; NULL for fewer than two."""
    window_of(window, min_periods)
    w = trailing(window)
    rows = panel.select(DATE, ASSET, anchored(v()).alias(VALUE), _row().cast("double").alias("_row"))
    slope = F.regr_slope(v(), F.col("_row")).over(w)
    return rows.select(DATE, ASSET, F.when(F.count(v()).over(w) >= max(2, min_periods), slope).alias(VALUE))
