"""Compound events of a stream of flagged days.

A session window of tau + delta days links days exactly as the batch operator does for tau of 0 or 1: windows that touch
are merged. The season's block is part of the key, so no event crosses a season.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compound_events(days: DataFrame, keys: Sequence[str], time: str = "ts", delta: int = 4, tau: int = 1, min_duration: int = 2, watermark: str = "0 days") -> DataFrame:
    """keys, block, start_day, end_day, length, n_extreme_cases of flagged days (keys, block, time); each day counts once."""
    if tau > 1:
        raise ValueError("sessions link days only for tau of 0 or 1")
    watched = days.withWatermark(time, watermark) if days.isStreaming else days
    grouped = watched.groupBy(*keys, "block", F.session_window(time, f"{tau + delta} days")).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.collect_set(F.to_date(time)).alias("_days"))
    out = grouped.where(F.size("_days") >= max(2, min_duration))
    return out.select(*keys, "block", F.to_date("_lo").alias("start_day"), F.to_date("_hi").alias("end_day"), (F.datediff("_hi", "_lo") + 1).alias("length"), F.size("_days").alias("n_extreme_cases"))
