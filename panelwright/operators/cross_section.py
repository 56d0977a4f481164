"""Each date on its own: scores, ranks, selection, regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at_least, by_date, finite, ratio, v, variance_of
from ..panel import ASSET, DATE, FLAG, VALUE

RANK_TOLERANCE = 1e-12  # norm under which a control adds no direction of its own


def row_counts(panel: DataFrame) -> DataFrame:
    """Present cells of each date."""
    return panel.groupBy(DATE).agg(F.count(v()).cast("double").alias(VALUE))


def row_means(panel: DataFrame) -> DataFrame:
    """Mean of each date's present cells."""
    return panel.groupBy(DATE).agg(F.avg(v()).alias(VALUE))


def standardize_rows(panel: DataFrame, ddof: int = 0) -> DataFrame:
    """Each date's values less their mean, by their standard deviation; 0 where that is 0."""
    if ddof < 0:
        raise ValueError(f"ddof must not be negative, got {ddof}")
    w = by_date()
    spread = F.sqrt(variance_of(v(), w, ddof))
    flat = F.max(v()).over(w) == F.min(v()).over(w)
    score = F.when(flat, F.lit(0.0)).otherwise(F.coalesce(ratio(v() - F.avg(v()).over(w), spread), F.lit(0.0)))
    return panel.select(DATE, ASSET, F.when(v().isNotNull() & (F.count(v()).over(w) > ddof), score).alias(VALUE))


def row_rank_pct(panel: DataFrame) -> DataFrame:
    """Rank of each value among its date's, by their number; equal ones in the order of assets."""
    place = F.row_number().over(Window.partitionBy(DATE, v().isNull()).orderBy(VALUE, ASSET)).cast("double")
    return panel.select(DATE, ASSET, F.when(v().isNotNull(), ratio(place, F.count(v()).over(by_date()).cast("double"))).alias(VALUE))


def row_rank_minmax(panel: DataFrame) -> DataFrame:
    """Ranks of each date from 0 to 1, equal values sharing their mean rank; NULL for fewer than two."""
    place = F.rank().over(Window.partitionBy(DATE, v().isNull()).orderBy(VALUE)).cast("double")
    equal = F.count(v()).over(Window.partitionBy(DATE, VALUE)).cast("double")
    n = F.count(v()).over(by_date()).cast("double")
    rank = place + (equal - 1.0) / 2.0
    return panel.select(DATE, ASSET, F.when(v().isNotNull() & (n > 1), ratio(rank - 1.0, n - 1.0)).alias(VALUE))


def top_n_mask(panel: DataFrame, top_n: int) -> DataFrame:
    """Flag of each date's top_n largest values; of equal ones the first assets."""
    at_least("top_n", top_n, 1)
    place = F.row_number().over(Window.partitionBy(DATE).orderBy(v().desc_nulls_last(), ASSET))
    return panel.select(DATE, ASSET, (v().isNotNull() & (place <= top_n)).alias(FLAG))


def project_out_rows(panel: DataFrame, controls: Sequence[str], eligible: str | None = None, *, target: str = VALUE) -> DataFrame:
    """Residual of each date's least squares of target on an intercept and the control columns.

    Only cells with the target and all controls, and eligible ones if a flag
    column is named, take part; others get NULL.  Each control is freed of the
    intercept and of those before it, twice, and the target of them all.  That
    is a window sum for each step, all by date, so in one exchange.  A control
    that leaves nothing, by the norm, is passed over.
    """
    w = by_date()
    usable = F.col(target).isNotNull()
    for c in controls:
        usable = usable & F.col(c).isNotNull()
    if eligible is not None:
        usable = usable & F.coalesce(F.col(eligible), F.lit(False))
    names = [f"_c{i}" for i in range(len(controls))]
    out = panel.withColumn("_ok", usable)
    only = lambda c: F.when(F.col("_ok"), F.col(c).cast("double"))
    out = out.withColumns({"_y": only(target), **{n: only(c) for n, c in zip(names, controls, strict=True)}})
    for _ in range(2):
        out = out.withColumns({n: F.col(n) - F.avg(n).over(w) for n in ["_y", *names]})

    def freed(df: DataFrame, c: str, of: str) -> DataFrame:
        slope = ratio(F.sum(F.col(c) * F.col(of)).over(w), F.sum(F.col(of) * F.col(of)).over(w))
        return df.withColumn(c, F.col(c) - F.coalesce(slope, F.lit(0.0)) * F.col(of))

    for i, n in enumerate(names):
        for _ in range(2):
            for before in names[:i]:
                out = freed(out, n, before)
        norm = F.sum(F.col(n) * F.col(n)).over(w)
        out = out.withColumn(n, F.when(F.col("_ok"), F.when(finite(norm) > RANK_TOLERANCE**2, F.col(n)).otherwise(F.lit(0.0))))
    for _ in range(2):
        for n in names:
            out = freed(out, "_y", n)
    return out.select(DATE, ASSET, F.col("_y").alias(VALUE))


def residualize_rows(panel: DataFrame, controls: Sequence[str], *, required_assets: int = 2, standardize: bool = True, target: str = VALUE) -> DataFrame:
    """project_out_rows(), NULL on dates with fewer than required_assets residuals, and standardized if asked."""
    residual = project_out_rows(panel, controls, target=target)
    kept = residual.withColumn(VALUE, F.when(F.count(v()).over(by_date()) >= required_assets, v()))
    return standardize_rows(kept) if standardize else kept


