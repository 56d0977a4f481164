"""Names and types that all operators share."""

from __future__ import annotations

from pyspark.sql import types as T

DATE, ASSET, VALUE, FRAME, FLAG = "date", "asset", "value", "frame", "flag"
DATE_COLUMN = DATE

PANEL_SCHEMA = T.StructType([T.StructField(DATE, T.TimestampNTZType()), T.StructField(ASSET, T.StringType()), T.StructField(VALUE, T.DoubleType())])
