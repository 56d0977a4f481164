"""Weights that drift with prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_date, finite, ratio
from ..panel import ASSET, DATE, VALUE
from ..sources.panels import matched


def drifted_weights(targets: DataFrame, reference_prices: DataFrame, current_prices: DataFrame) -> DataFrame:
    """Each date's target weights after prices moved from reference to current.

    A date is NULL as a whole if a weight is missing, a weight other than 0 has
    no two positive prices, the book's value is not positive, or a result
    overflows.  A weight of 0 needs no price.  Panels whose labels differ are refused.
    """
    w = by_date()
    all_ = matched({"w": targets, "p": reference_prices, "q": current_prices})
    ok = F.col("w").isNotNull() & ((F.col("w") == 0) | F.coalesce((F.col("p") > 0) & (F.col("q") > 0), F.lit(False)))
    moved = F.when(F.col("w") == 0, F.lit(1.0)).otherwise(ratio(F.col("q"), F.col("p")))
    all_ = all_.select(DATE, ASSET, "w", F.coalesce(ok, F.lit(False)).alias("ok"), moved.alias("moved"))
    value = finite(1.0 + F.sum(F.col("w") * (F.col("moved") - 1.0)).over(w))
    good = F.bool_and("ok").over(w)
    all_ = all_.select(DATE, ASSET, F.when(good & (value > 0), finite(F.col("w") * F.col("moved") / F.when(value > 0, value))).alias(VALUE))
    return all_.select(DATE, ASSET, F.when(F.bool_and(F.col(VALUE).isNotNull()).over(w), F.col(VALUE)).alias(VALUE))
