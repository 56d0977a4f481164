"""One panel out of a stack: reductions across frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, variance_of
from ..panel import ASSET, DATE, FRAME, VALUE

SHARE = "share"


def _across(stack: DataFrame, value: Column) -> DataFrame:
    return stack.groupBy(DATE, ASSET).agg(value.alias(VALUE))


def _zero(c: str = VALUE) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _with_shares(stack: DataFrame, shares, keys: list[str], check: bool) -> DataFrame:
    """stack with its frames' shares; a frame without one, or with one that is missing or negative, is an error if checked, which runs a job."""
    if isinstance(shares, dict):
        shares = stack.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{FRAME} string, {SHARE} double")
    out = stack.join(shares.select(*keys, SHARE), keys, "left")
    if check:
        ok = F.col(SHARE).isNotNull() & ~F.isnan(SHARE) & (F.col(SHARE) >= 0) & (F.col(SHARE) < float("inf"))
        bad = stack.select(*keys).distinct().join(shares.select(*keys, SHARE), keys, "left").where(~F.coalesce(ok, F.lit(False)))
        if not bad.isEmpty():
            raise ValueError("every frame needs a share that is finite and not negative")
    return out


def nanmean_stack(stack: DataFrame) -> DataFrame:
    """Mean of the present cells."""
    return _across(stack, F.avg(VALUE))


def nanmedian_stack(stack: DataFrame) -> DataFrame:
    """Exact median of the present cells, between the middle two if their number is even."""
    return _across(stack, F.median(VALUE))


def _weighted(stack: DataFrame) -> DataFrame:
    share = F.when(F.col(VALUE).isNotNull(), F.col(SHARE))
    total = F.sum(share)
    return _across(stack, F.when(total > 0, ratio(F.sum(F.col(VALUE) * F.col(SHARE)), total)))


def weighted_nanmean_stack(stack: DataFrame, shares, *, check: bool = True) -> DataFrame:
    """Weighted mean; a gap leaves both sums.  shares: by frame, a dict or (frame, share)."""
    return _weighted(_with_shares(stack, shares, [FRAME], check))


def weighted_nanmean_stack_over_time(stack: DataFrame, shares: DataFrame, *, check: bool = True) -> DataFrame:
    """As weighted_nanmean_stack, with a share for each frame and date (frame, date, share)."""
    return _weighted(_with_shares(stack, shares, [FRAME, DATE], check))


def mean_stack(stack: DataFrame) -> DataFrame:
    """Mean over all frames; a gap counts as 0."""
    return _across(stack, F.avg(_zero()))


def weighted_mean_stack(stack: DataFrame, shares, *, check: bool = True) -> DataFrame:
    """Weighted mean over all frames; a gap counts as 0 and keeps its share."""
    both = _with_shares(stack, shares, [FRAME], check)
    return _across(both, ratio(F.sum(_zero() * F.col(SHARE)), F.sum(SHARE)))


def mean_stack_over_time(stack: DataFrame, shares: DataFrame, *, check: bool = True) -> DataFrame:
    """Weighted mean with a share for each frame and date; a gap counts as 0, unless its frame says nothing on that date, which drops its share."""
    both = _with_shares(stack, shares, [FRAME, DATE], check)
    speaks = F.count(VALUE).over(Window.partitionBy(FRAME, DATE)) > 0
    both = both.withColumn("_used", F.when(speaks, F.col(SHARE)).otherwise(F.lit(0.0)))
    total = F.sum("_used")
    return _across(both, F.when(total > 0, ratio(F.sum(_zero() * F.col("_used")), total)))


def normalised_shares(scores: DataFrame) -> DataFrame:
    """(frame, share) from (frame, value): positive scores divided by their sum, or equal ones if none is positive."""
    raw = F.when(F.col(VALUE) > 0, F.col(VALUE)).otherwise(F.lit(0.0))
    total = scores.agg(F.sum(raw).alias("_total"), F.count("*").alias("_n"))  # one row
    share = F.when(F.col("_total") > 0, ratio(raw, F.col("_total"))).otherwise(ratio(F.lit(1.0), F.col("_n").cast("double")))
    return scores.crossJoin(F.broadcast(total)).select(FRAME, share.alias(SHARE))


def stack_volatility(stack: DataFrame, *, ddof: int = 1) -> DataFrame:
    """(frame, value): standard deviation of all present cells of each frame."""
    if ddof < 0:
        raise ValueError(f"ddof must not be negative, got {ddof}")
    return stack.groupBy(FRAME).agg(F.sqrt(variance_of(F.col(VALUE), None, ddof)).alias(VALUE))
