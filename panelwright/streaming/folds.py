"""The exponentially weighted mean and the no-trade band as stateful streams.

Each asset is a key; its state is what the batch operators carry from row to row.
Rows of an asset must come in the order of dates across batches; within a batch
they are sorted.  A row that is not later than the last one is left out, as its
place has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import at_least, positive
from ..operators.band import band_step
from ..operators.smoothing import ewm_steps
from ..panel import ASSET, DATE, VALUE


def _in_order(frames: Iterator[pd.DataFrame], last: str | None) -> pd.DataFrame:
    rows = pd.concat(list(frames)).sort_values(DATE)
    return rows if last is None else rows[rows[DATE] > pd.Timestamp(last)]


def _run(stream: DataFrame, step, state_type: str) -> DataFrame:
    out = T.StructType([stream.schema[DATE], stream.schema[ASSET], T.StructField(VALUE, T.DoubleType())])
    return stream.groupBy(ASSET).applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.NoTimeout)


def stream_ewm(panel: DataFrame, span: int) -> DataFrame:
    """ewm_mean() of a stream (date, asset, value)."""
    at_least("span", span, 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *kept = state.get if state.exists else (None, 0.0, 0.0, 0)
        rows = _in_order(frames, last)
        if len(rows):
            made = list(ewm_steps(rows[VALUE].astype(float).tolist(), span, tuple(kept)))
            state.update((str(rows[DATE].iloc[-1]), *made[-1][1]))
            yield pd.DataFrame({DATE: rows[DATE], ASSET: key[0], VALUE: [m for m, _ in made]})

    return _run(panel, step, "last string, mean double, weight double, seen long")


def stream_band(target: DataFrame, band: float) -> DataFrame:
    """no_trade_band() of a stream (date, asset, value, scale), scale being the mean size of the date's cells."""
    positive("band", band)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, None)
        current = float("nan") if held is None else held
        rows = _in_order(frames, last)
        if len(rows):
            out = []
            for wanted, scale in zip(rows[VALUE].astype(float), rows["scale"].astype(float), strict=True):
                current = band_step(current, wanted, band * scale)
                out.append(current)
            state.update((str(rows[DATE].iloc[-1]), None if current != current else current))
            yield pd.DataFrame({DATE: rows[DATE], ASSET: key[0], VALUE: out})

    return _run(target, step, "last string, held double")
