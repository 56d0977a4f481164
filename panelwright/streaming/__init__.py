"""Recursions over a stream of panel rows."""

from .folds import stream_band, stream_ewm

__all__ = ["stream_band", "stream_ewm"]
