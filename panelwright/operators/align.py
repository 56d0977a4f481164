"""Joining panels: union alignment and as-of carrying."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..panel import ASSET, DATE, FRAME, VALUE


def align(frames: dict[str, DataFrame]) -> DataFrame:
    """A stack (frame, date, asset, value), dense over the union of all dates and assets.

    frames: panels by name; one without rows still has its place.
    """
    if not frames:
        raise ValueError("at least one frame is needed")
    spark = next(iter(frames.values())).sparkSession
    cells = reduce(DataFrame.unionByName, [f.select(F.lit(name).alias(FRAME), DATE, ASSET, VALUE) for name, f in frames.items()])
    names = spark.createDataFrame([(n,) for n in frames], f"{FRAME} string")
    # both axes are distinct values, and their product is the result's own size
    grid = cells.select(DATE).distinct().crossJoin(cells.select(ASSET).distinct()).crossJoin(names)
    return grid.join(cells, [FRAME, DATE, ASSET], "left").select(FRAME, DATE, ASSET, VALUE)


def stack_count(frames: dict[str, DataFrame]) -> int:
    """Frames of a stack, those without rows included."""
    return len(frames)


def carried(frame: DataFrame, grid: DataFrame, *, max_age: timedelta | None = None) -> DataFrame:
    """For each date of grid the newest row of frame that is not later, as a whole; no older than max_age.

    A gap within that row stays a gap.  Only dates go through the window; cells
    are joined to them by date.
    """
    if max_age is not None and max_age < timedelta(0):
        raise ValueError("max_age must not be negative")
    sources = frame.select(F.col(DATE).alias("at"), F.col(DATE).alias("source"), F.lit(0).alias("is_grid")).distinct()
    wanted = grid.select(F.col(DATE).alias("at"), F.lit(None).cast(frame.schema[DATE].dataType).alias("source"), F.lit(1).alias("is_grid")).distinct()
    newest = F.last("source", ignorenulls=True).over(Window.orderBy("at", "is_grid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dates = sources.unionByName(wanted).withColumn("from", newest).where("is_grid = 1").select(F.col("at").alias(DATE), "from")
    if max_age is not None:
        dates = dates.withColumn("from", F.when(F.col(DATE) - F.col("from") <= F.lit(max_age), F.col("from")))
    cells = frame.select(F.col(DATE).alias("from"), ASSET, VALUE)
    axis = frame.select(ASSET).distinct()
    return dates.crossJoin(axis).join(cells, ["from", ASSET], "left").select(DATE, ASSET, VALUE)
