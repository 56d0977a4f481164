"""Performance of return series (date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import positive, ratio, v
from ..panel import DATE, VALUE

DEGENERATE_SHARPE = -10.0


def _growth() -> Column:
    return F.coalesce(F.product(1.0 + v()), F.lit(1.0))


def _to_date():
    # one partition, of a row for each date
    return Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def compounded(returns: DataFrame) -> DataFrame:
    """One row: the product of 1 + return, less 1; gaps are passed over."""
    return returns.agg((_growth() - 1.0).alias(VALUE))


def to_prices(returns: DataFrame, base: float = 1.0) -> DataFrame:
    """Prices from base; NULL where the return is missing."""
    return returns.select(DATE, F.when(v().isNotNull(), F.lit(float(base)) * F.product(1.0 + v()).over(_to_date())).alias(VALUE))


def cagr(returns: DataFrame, days: float, periods: float = 365.0) -> DataFrame:
    """One row: yearly growth over days."""
    positive("days", days)
    return returns.agg((F.pow(F.abs(_growth()), F.lit(float(periods) / float(days))) - 1.0).alias(VALUE))


def sharpe(returns: DataFrame, annualization_period: float = 365.0) -> DataFrame:
    """One row: mean by standard deviation, yearly; DEGENERATE_SHARPE for fewer than two returns or equal ones."""
    varies = F.max(v()) > F.min(v())
    value = ratio(F.avg(v()), F.stddev_samp(v())) * F.lit(float(annualization_period) ** 0.5)
    return returns.agg(F.coalesce(F.when(varies, value), F.lit(DEGENERATE_SHARPE)).alias(VALUE))


def beta(returns: DataFrame, underlying: DataFrame) -> DataFrame:
    """One row: covariance with the underlying by its variance, over the dates both have."""
    both = returns.select(DATE, v().alias("y")).join(underlying.select(DATE, v().alias("x")), DATE)
    return both.agg(F.regr_slope("y", "x").alias(VALUE))


def drawdown(returns: DataFrame) -> DataFrame:
    """Price by its highest so far, less 1; the first price is the first peak."""
    prices = to_prices(returns)
    return prices.select(DATE, (ratio(v(), F.max(v()).over(_to_date())) - 1.0).alias(VALUE))


def max_drawdown(returns: DataFrame) -> DataFrame:
    """One row: the lowest drawdown, 0 if there is none."""
    return drawdown(returns).agg(F.coalesce(F.min(v()), F.lit(0.0)).alias(VALUE))
