"""Turnover, trading costs and book returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least, by_asset, v
from ..panel import ASSET, DATE, VALUE
from ..sources.panels import pair


def _turnover(c: str = VALUE):
    x = F.coalesce(F.col(c), F.lit(0.0))
    return F.abs(x - F.lag(x).over(by_asset()))


def turnover(weights: DataFrame) -> DataFrame:
    """Size of each cell's change, a gap counting as 0; 0 in the first row."""
    return weights.select(DATE, ASSET, F.coalesce(_turnover(), F.lit(0.0)).alias(VALUE))


def lagged(weights: DataFrame, lag: int) -> DataFrame:
    """Weights of 1 + lag rows before, those that earn a row's return."""
    at_least("lag", lag, 0)
    return weights.select(DATE, ASSET, F.lag(v(), 1 + lag).over(by_asset()).alias(VALUE))


def apply_costs(weights: DataFrame, returns: DataFrame, *, cost: float, lag: int = 0) -> DataFrame:
    """What each cell earns: its lagged weight times the return, 0 if one is missing, less cost times its turnover.  Panels whose labels differ are refused."""
    at_least("lag", lag, 0)
    if cost < 0:
        raise ValueError(f"cost must not be negative, got {cost}")
    both = pair(weights, returns, ("w", "r"))
    earned = F.coalesce(F.lag("w", 1 + lag).over(by_asset()) * F.col("r"), F.lit(0.0))
    return both.select(DATE, ASSET, (earned - F.lit(float(cost)) * F.coalesce(_turnover("w"), F.lit(0.0))).alias(VALUE))


def book_returns(weights: DataFrame, returns: DataFrame, *, cost: float = 0.0, lag: int = 0) -> DataFrame:
    """(date, value): apply_costs() summed over assets."""
    return apply_costs(weights, returns, cost=cost, lag=lag).groupBy(DATE).agg(F.sum(v()).alias(VALUE))
