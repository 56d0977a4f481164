"""Smoothing and shifts; answers begin when the window is full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import at_least, by_asset, v
from ..panel import ASSET, DATE, VALUE
from .rolling import partial_rolling_mean


def rolling_mean(panel: DataFrame, window: int) -> DataFrame:
    """Mean of a window without gaps."""
    return partial_rolling_mean(panel, window, window)


def lag_rows(panel: DataFrame, periods: int) -> DataFrame:
    """Values of periods rows before."""
    at_least("periods", periods, 0)
    return panel if periods == 0 else panel.select(DATE, ASSET, F.lag(v(), periods).over(by_asset()).alias(VALUE))


def along_dates(panel: DataFrame, fold, columns: tuple[str, ...] = (VALUE,)) -> DataFrame:
    """fold(*columns as arrays) of each asset in the order of dates, an array of its values.

    For recursions: an asset's history is folded in one task, assets side by side.
    """
    schema = T.StructType([panel.schema[DATE], panel.schema[ASSET], T.StructField(VALUE, T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(DATE)
        made = fold(*[table.column(c).to_numpy().astype(np.float64) for c in columns])
        return pa.table([table.column(DATE), table.column(ASSET), pa.array(made, from_pandas=True)], names=[DATE, ASSET, VALUE])

    return panel.select(DATE, ASSET, *columns).groupBy(ASSET).applyInArrow(run, schema)


def ewm_steps(values: Iterator[float], span: int, state: tuple[float, float, int] = (0.0, 0.0, 0)) -> Iterator[tuple[float, tuple]]:
    """The exponentially weighted mean after each value, with the state (mean, weight, observations) to go on from.

    The mean is moved by the new value's part of all weight, which neither
    grows nor vanishes however long a gap lasts.
    """
    decay = 1.0 - 2.0 / (span + 1.0)
    mean, weight, seen = state
    for v in values:
        present = v == v
        if present:
            weight = weight * decay + 1.0
            mean += (v - mean) / weight
            seen += 1
        else:
            weight *= decay
        known = seen >= span and (present or decay > 0.0)
        yield (mean if known else float("nan")), (mean, weight, seen)


def ewm_mean(panel: DataFrame, span: int) -> DataFrame:
    """Exponentially weighted mean, 2 / (span + 1) the weight of the newest; from span observations on.

    A gap ages the weights and repeats the mean.
    """
    at_least("span", span, 1)
    return along_dates(panel, lambda v: np.array([m for m, _ in ewm_steps(v.tolist(), span)], dtype=np.float64))
