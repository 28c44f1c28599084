"""Calendar predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_window(ts: Column, start_hour: int, end_hour: int, blackout: Column | None = None) -> Column:
    """Whether a time is in a daily window (which may pass midnight) and not blacked out."""
    h = F.hour(ts)
    inside = (h >= start_hour) & (h < end_hour) if start_hour <= end_hour else (h >= start_hour) | (h < end_hour)
    return inside if blackout is None else inside & ~blackout
