"""Row-wise sizing of books: exposures, caps, lots, tilts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_date, finite, positive, ratio, v
from ..panel import ASSET, DATE, FLAG, VALUE
from ..sources.panels import pair


def _by_row(panel: DataFrame, value: Column) -> DataFrame:
    return panel.groupBy(DATE).agg(value.alias(VALUE))


def _zero_sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def is_held(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def row_sums(panel: DataFrame) -> DataFrame:
    """Sum of each date's present cells, 0 if there are none."""
    return _by_row(panel, _zero_sum(v()))


def held(panel: DataFrame) -> DataFrame:
    """Flag of the cells that are present and not 0."""
    return panel.select(DATE, ASSET, is_held(v()).alias(FLAG))


def fill_missing(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """preferred where it is present, else fallback."""
    return pair(preferred, fallback, ("p", "f")).select(DATE, ASSET, F.coalesce("p", "f").alias(VALUE))


def share_of_held(measure: Column, holdings: Column, power: float = 1.0) -> Column:
    """measure ** power as a share of its date's sum, times the number of holdings; 0 where there is none."""
    raw = finite(measure if power == 1.0 else F.pow(measure, F.lit(float(power))))
    share = finite(ratio(raw, F.sum(raw).over(by_date())))
    return F.coalesce(share, F.lit(0.0)) * F.sum(holdings.cast("int")).over(by_date())


def normalised_share(measure: DataFrame, holdings: DataFrame, *, power: float) -> DataFrame:
    """Shares of measure ** power that sum to the number of holdings of the date."""
    both = pair(measure, holdings, ("m", "h"))
    return both.select(DATE, ASSET, share_of_held(F.col("m"), F.col("h"), power).alias(VALUE))


def rescaled_to_held_count(side: DataFrame) -> DataFrame:
    """Each date's values scaled to sum to the number of them."""
    w = by_date()
    return side.select(DATE, ASSET, (ratio(v(), F.sum(v()).over(w)) * F.count(v()).over(w)).alias(VALUE))


def gross(panel: DataFrame) -> DataFrame:
    """Sum of absolute values of each date."""
    return _by_row(panel, _zero_sum(F.abs(v())))


def net(panel: DataFrame) -> DataFrame:
    """Sum of values of each date."""
    return _by_row(panel, _zero_sum(v()))


def to_gross(panel: DataFrame, target: float) -> DataFrame:
    """Each date scaled to a gross of target; one with a gross of 0 stays."""
    positive("target", target)
    g = F.sum(F.abs(v())).over(by_date())
    scaled = F.when((g > 0) & (g < float("inf")), v() * (F.lit(float(target)) / F.when(g > 0, g))).otherwise(v())
    return panel.select(DATE, ASSET, scaled.alias(VALUE))


def _scale(gross_: Column, net_: Column, max_gross: float | None, max_net: float | None) -> Column:
    out = F.lit(1.0)
    for limit, size in ((max_gross, gross_), (max_net, F.abs(net_))):
        if limit is not None:
            out = F.least(out, F.when(size > 0, ratio(F.lit(float(limit)), size)).otherwise(F.lit(1.0)))
    return out


def _limits(max_gross: float | None, max_net: float | None) -> None:
    for name, limit in (("max_gross", max_gross), ("max_net", max_net)):
        if limit is not None:
            positive(name, limit)


def exposure_scale(panel: DataFrame, *, max_gross: float | None = None, max_net: float | None = None) -> DataFrame:
    """For each date the largest factor up to 1 that keeps its gross and net within limits."""
    _limits(max_gross, max_net)
    return _by_row(panel, _scale(_zero_sum(F.abs(v())), _zero_sum(v()), max_gross, max_net))


def capped(panel: DataFrame, *, max_gross: float | None = None, max_net: float | None = None) -> DataFrame:
    """Each date times its exposure_scale()."""
    _limits(max_gross, max_net)
    if max_gross is None and max_net is None:
        return panel
    w = by_date()
    return panel.select(DATE, ASSET, (v() * _scale(F.sum(F.abs(v())).over(w), F.sum(v()).over(w), max_gross, max_net)).alias(VALUE))


def center(panel: DataFrame) -> DataFrame:
    """Each date less its mean."""
    return panel.select(DATE, ASSET, (v() - F.avg(v()).over(by_date())).alias(VALUE))


def clip_allocation(panel: DataFrame, cap: float) -> DataFrame:
    """Values between -cap and cap."""
    positive("cap", cap)
    limit = F.lit(float(cap))
    return panel.withColumn(VALUE, F.when(v().isNotNull(), F.greatest(F.least(v(), limit), -limit)))


def quantize(panel: DataFrame, step: float) -> DataFrame:
    """Values as the nearest multiple of step, the even one of two as near."""
    positive("step", step)
    return panel.withColumn(VALUE, F.rint(v() / F.lit(float(step))) * F.lit(float(step)))


def tilt(panel: DataFrame, amount: float) -> DataFrame:
    """amount spread evenly over what each date holds."""
    h = is_held(v())
    n = F.sum(h.cast("int")).over(by_date())
    return panel.select(DATE, ASSET, F.when(h, v() + ratio(F.lit(float(amount)), n.cast("double"))).otherwise(v()).alias(VALUE))


def weights_from_bins(binned: DataFrame) -> DataFrame:
    """Each date's bins mapped evenly to -1 ... 1 and scaled to a gross of 1; 0 where all bins are equal."""
    w = by_date()
    low, high = F.min(v()).over(w), F.max(v()).over(w)
    line = F.when(v().isNotNull(), F.coalesce(F.when(high > low, ratio(v() - low, high - low) * 2.0 - 1.0), F.lit(0.0)))
    lined = binned.select(DATE, ASSET, line.alias(VALUE))
    total = F.sum(F.abs(v())).over(w)
    return lined.select(DATE, ASSET, F.when(v().isNotNull(), F.coalesce(F.when(total > 0, v() / F.when(total > 0, total)), F.lit(0.0))).alias(VALUE))
