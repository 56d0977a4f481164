"""Building, checking and reshaping panels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..panel import ASSET, DATE, FLAG, PANEL_SCHEMA, VALUE

__all__ = ["densify", "equal_panels", "from_rows", "from_wide", "has_dates", "is_empty", "last_row", "matched", "read_wide", "sanitize", "shape", "to_wide", "validate", "with_values"]


def sanitize(panel: DataFrame, *columns: str) -> DataFrame:
    """panel with NaN and infinities as NULL; missing has one form from here on."""
    return panel.withColumns({c: finite(F.col(c)) for c in columns or (VALUE,)})


def validate(panel: DataFrame, keys: Sequence[str] = (DATE, ASSET)) -> DataFrame:
    """panel, or ValueError if a key occurs twice or is null.  Runs a job."""
    missing = [k for k in keys if k not in panel.columns]
    if missing:
        raise ValueError(f"no column {missing[0]}")
    bad = panel.groupBy(*keys).count().where(F.col("count") > 1).limit(1).union(panel.where(" or ".join(f"{k} is null" for k in keys)).groupBy(*keys).count().limit(1))
    found = bad.first()
    if found is not None:
        raise ValueError(f"repeated or null key: {[found[k] for k in keys]}")
    return panel


def densify(cells: DataFrame, dates: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """A row for every date and asset of cells, or of the axes given; NULL where cells has none.

    The axes are distinct values, so their product is the panel itself.
    """
    dates = (cells if dates is None else dates).select(DATE).distinct()
    assets = (cells if assets is None else assets).select(ASSET).distinct()
    return dates.crossJoin(assets).join(cells, [DATE, ASSET], "left")


def from_rows(spark: SparkSession, dates: Iterable, assets: Sequence[str], values: Iterable[Sequence[float | None]]) -> DataFrame:
    """A panel from dates (ISO strings or datetimes), assets and a row of values for each date."""
    dates, values, assets = list(dates), [list(r) for r in values], list(assets)
    if len(dates) != len(values) or any(len(r) != len(assets) for r in values):
        raise ValueError("values do not fit the dates and assets")
    if len(set(assets)) != len(assets) or len(set(map(str, dates))) != len(dates):
        raise ValueError("dates and assets must be distinct")
    rows = [(str(d), a, None if v is None else float(v)) for d, r in zip(dates, values, strict=True) for a, v in zip(assets, r, strict=True)]
    out = spark.createDataFrame(rows, "d string, asset string, value double")
    return sanitize(out.select(F.col("d").cast("timestamp_ntz").alias(DATE), ASSET, VALUE))


def from_wide(wide: DataFrame, date: str = DATE) -> DataFrame:
    """A panel from a date column and a numeric column for each asset."""
    if date not in wide.columns:
        raise ValueError(f"no column {date}")
    assets = [c for c in wide.columns if c != date]
    if len(set(wide.columns)) != len(wide.columns):
        raise ValueError("columns must be distinct")
    if not assets:
        return wide.sparkSession.createDataFrame([], PANEL_SCHEMA)
    cast = wide.select(F.col(date).alias(DATE), *[F.col(f"`{a}`").cast("double").alias(a) for a in assets])
    return sanitize(cast.unpivot([DATE], [f"`{a}`" for a in assets], ASSET, VALUE))


def to_wide(panel: DataFrame, assets: Sequence[str] | None = None, value: str = VALUE) -> DataFrame:
    """A date column and one for each asset; without assets, those of the panel are looked up first."""
    if assets is None:
        assets = [r[0] for r in panel.select(ASSET).distinct().orderBy(ASSET).collect()]  # as many as the result has columns
    return panel.groupBy(DATE).pivot(ASSET, list(assets)).agg(F.first(value))


def read_wide(spark: SparkSession, path: str, date: str = DATE) -> DataFrame:
    """from_wide() of a Parquet table."""
    return from_wide(spark.read.parquet(path), date)


def with_values(panel: DataFrame, expression, value: str = VALUE) -> DataFrame:
    """panel with the same labels and another value column."""
    return panel.withColumn(value, expression)


def last_row(panel: DataFrame) -> DataFrame:
    """(asset, value) of the last date; ValueError if there is none."""
    last = panel.agg(F.max(DATE)).first()[0]
    if last is None:
        raise ValueError("the panel has no dates")
    return panel.where(F.col(DATE) == F.lit(last)).select(ASSET, VALUE)


def shape(panel: DataFrame) -> tuple[int, int]:
    """Numbers of dates and of assets."""
    r = panel.agg(F.countDistinct(DATE), F.countDistinct(ASSET)).first()
    return r[0], r[1]


def is_empty(panel: DataFrame) -> bool:
    return panel.isEmpty()


def has_dates(dates: DataFrame) -> bool:
    """Whether an axis, or a panel, has a date; a panel without assets needs its axis for this."""
    return not dates.select(DATE).isEmpty()


def equal_panels(left: DataFrame, right: DataFrame, value: str = VALUE) -> bool:
    """Whether labels and values agree, missing equal to missing."""
    a = left.select(DATE, ASSET, F.col(value).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(DATE, ASSET, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    both = a.join(b, [DATE, ASSET], "full")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).isEmpty()


def matched(frames: dict[str, DataFrame], value: str = VALUE) -> DataFrame:
    """(date, asset, <names>) of panels, or flags, that have the same labels.

    A label that one of them lacks, or has twice, is an error when the rows are
    computed, as lags and sums over what is left would be wrong.  All are taken
    together in one aggregation: one exchange, no sort, and no job of its own.
    """
    parts = []
    for name, f in frames.items():
        mine = F.col(FLAG if value not in f.columns and FLAG in f.columns else value)
        parts.append(f.select(DATE, ASSET, mine.alias(name), F.lit(1).alias(f"{name}_seen")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    both = both.groupBy(DATE, ASSET).agg(*[F.first(n, ignorenulls=True).alias(n) for n in frames], *[F.sum(f"{n}_seen").alias(f"{n}_seen") for n in frames])
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{n}_seen") == 1, F.lit(False)) for n in frames])
    return both.select(DATE, ASSET, *[_checked(F.col(n), ok, both.schema[n].dataType, " and ".join(frames)).alias(n) for n in frames])


def _checked(x: Column, ok: Column, kind, names: str) -> Column:
    where = F.concat_ws(" ", F.lit(f"the labels of {names} do not match at"), F.col(DATE).cast("string"), F.col(ASSET).cast("string"))
    return F.when(ok, x).otherwise(F.raise_error(where).cast(kind))


def pair(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right"), value: str = VALUE) -> DataFrame:
    """matched() of two panels.  A right side without asset holds for all of them, and has the left's dates."""
    if ASSET in right.columns:
        return matched({names[0]: left, names[1]: right}, value)
    a = left.select(DATE, ASSET, F.col(value).alias(names[0]), F.lit(True).alias("_a"))
    b = right.select(DATE, F.col(value).alias(names[1]), F.lit(True).alias("_b"))
    both = a.join(b, DATE, "full")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.select(DATE, ASSET, *[_checked(F.col(n), ok, both.schema[n].dataType, " and ".join(names)).alias(n) for n in names])
