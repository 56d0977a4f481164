"""Portfolio-panel analytics on Spark DataFrames.

A panel is a long, dense DataFrame (date, asset, value): every date has a row for
every asset, and what is missing is NULL.  A stack adds a column frame; a series
is (date, value).  Operators take and return DataFrames and stay lazy.
"""

from .panel import ASSET, DATE, DATE_COLUMN, FRAME, VALUE

__all__ = ["ASSET", "DATE", "DATE_COLUMN", "FRAME", "VALUE"]
