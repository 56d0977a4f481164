"""A no-trade band."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_date, positive
from ..panel import VALUE
from .smoothing import along_dates


def band_step(current: float, wanted: float, limit: float) -> float:
    """The weight held after a row: wanted if it, or what was held, is missing, or if it is further than limit from it."""
    if not limit > 0 or wanted != wanted or current != current:
        return wanted
    return wanted if abs(wanted - current) > limit else current


def with_limits(target: DataFrame, band: float) -> DataFrame:
    """target with limit: band times the mean size of each date's present cells."""
    return target.withColumn("limit", F.lit(float(band)) * F.avg(F.abs(VALUE)).over(by_date()))


def no_trade_band(target: DataFrame, band: float) -> DataFrame:
    """Weights that follow target only when it moves by more than band times its date's mean size.

    Entries and exits, and dates without a size, follow at once.  The limits
    depend on target alone, so each asset is a recursion of its own.
    """
    positive("band", band)

    def fold(wanted: np.ndarray, limit: np.ndarray) -> np.ndarray:
        out, current = np.empty(len(wanted)), float("nan")
        for i, (w, x) in enumerate(zip(wanted.tolist(), limit.tolist(), strict=True)):
            out[i] = current = band_step(current, w, x)
        return out

    return along_dates(with_limits(target, band), fold, (VALUE, "limit"))
