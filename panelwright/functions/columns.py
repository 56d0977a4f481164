"""Column expressions: missing values, safe division, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..panel import ASSET, DATE, VALUE

INFINITY = float("inf")


def v() -> Column:
    """The value column."""
    return F.col(VALUE)


def finite(c: Column) -> Column:
    """c as a double, NULL where it is NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < INFINITY), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def by_date() -> WindowSpec:
    return Window.partitionBy(DATE)


def by_asset() -> WindowSpec:
    return Window.partitionBy(ASSET).orderBy(DATE)


def trailing(rows: int, spec: WindowSpec | None = None) -> WindowSpec:
    """The current row and those before it, rows in all."""
    return (spec or by_asset()).rowsBetween(-(rows - 1), Window.currentRow)


def whole(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_asset()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def anchored(x: Column, spec: WindowSpec | None = None) -> Column:
    """x less the first present value of its series.  Variances, covariances and
    slopes do not change by it, and keep their digits where the level is large."""
    return x - F.first(x, ignorenulls=True).over(whole(spec))


def variance_of(x: Column, w, ddof: int) -> Column:
    """Variance with ddof degrees of freedom less, NULL for ddof values or fewer.

    w is a window, or None for an aggregate.
    """
    n, var = F.count(x), F.var_pop(x)
    n, var = (n.over(w), var.over(w)) if w is not None else (n, var)
    return F.when(n > ddof, var * n / (n - ddof))


#: Windows of more rows than this are put together from parts of blocks, a few steps a row; shorter ones are gone through for each row.
SLIDING = 64


def with_moments(rows: DataFrame, x: Column, window: int, order: WindowSpec | None = None, keys: tuple = (ASSET,)) -> DataFrame:
    """rows with n, total, spread (sum of squared deviations), least and most of the present x in each trailing window.

    A long window is the end of one block of so many rows and the beginning of
    the next.  Both are running aggregates, one forward, one backward, so the
    work for each row does not grow with the window, and nothing is subtracted.
    """
    names = ("n", "total", "spread", "least", "most")

    def over(w: WindowSpec) -> list[Column]:
        n = F.count(x).over(w)
        return [n, F.sum(x).over(w), F.var_pop(x).over(w) * n, F.min(x).over(w), F.max(x).over(w)]

    order = order or Window.partitionBy(*keys).orderBy(DATE)
    if window <= SLIDING:
        return rows.select("*", *[c.alias(a) for a, c in zip(names, over(trailing(window, order)), strict=True)])
    at = F.row_number().over(order) - 1
    rows = rows.select("*", F.floor(at / window).alias("_block"), F.pmod(at, F.lit(window)).alias("_at"))
    block = Window.partitionBy(*keys, "_block")
    forward, backward = (whole_to_now(block.orderBy(d)) for d in (F.col(DATE), F.col(DATE).desc()))
    rows = rows.select("*", *[c.alias(f"_a_{a}") for a, c in zip(names, over(forward), strict=True)], *[c.alias(f"_b_{a}") for a, c in zip(names, over(backward), strict=True)])
    # the end of the block before: what was gathered backward at the window's first row
    before = F.when(F.col("_at") < window - 1, F.lit(True))
    rows = rows.select("*", *[F.when(before, F.lag(f"_b_{a}", window - 1).over(order)).alias(f"_c_{a}") for a in names])
    n, m = F.col("_a_n"), F.coalesce("_c_n", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    apart = ratio(zero("_a_total"), n.cast("double")) - ratio(zero("_c_total"), m.cast("double"))
    between = F.coalesce(apart * apart * n * m / (n + m), F.lit(0.0))
    made = [n + m, F.when(n + m > 0, zero("_a_total") + zero("_c_total")), zero("_a_spread") + zero("_c_spread") + between, F.least("_a_least", "_c_least"), F.greatest("_a_most", "_c_most")]
    kept = [c for c in rows.columns if c not in ("_block", "_at") and c[:3] not in ("_a_", "_b_", "_c_")]
    return rows.select(*kept, *[c.alias(a) for a, c in zip(names, made, strict=True)])


def whole_to_now(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def positive(name: str, value: float) -> None:
    if not value > 0:
        raise ValueError(f"{name} must be positive, got {value}")


def at_least(name: str, value: int, least: int) -> None:
    if value < least:
        raise ValueError(f"{name} must be at least {least}, got {value}")


def window_of(window: int, min_periods: int) -> None:
    at_least("window", window, 1)
    at_least("min_periods", min_periods, 1)
    if min_periods > window:
        raise ValueError(f"min_periods {min_periods} exceeds the window {window}")
