"""Coincidence counts over sliding periods under a fixed and a percentile-matched threshold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormspan.functions.calendar import calendar_block, periods_table
from stormspan.operators import coincidence
from stormspan.operators.flagging import flag_extremes, matched_thresholds

Detector = Callable[[DataFrame, Sequence[str], Column, int], DataFrame]


@dataclass(frozen=True)
class WindowConfig:
    periods: tuple[str, ...] = ("1980-2010", "1990-2020", "2000-2030", "2010-2040", "2020-2050", "2030-2060", "2040-2070", "2050-2080")
    baseline: str = "1980-2010"
    fixed_threshold: float = 20.0
    months: tuple[int, ...] = (6, 7, 8, 9)
    spell: int = 1
    delta: int = 4
    tau: int = 1
    year_blocked: bool = True
    null_model: str = "pooled"
    band: tuple[float, float] = (0.025, 0.975)
    thermo_points: str = "thermo"
    detector: Detector | None = field(default=None, compare=False)


def in_periods(series: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Rows of each period (years at both ends included); a day is in all periods that hold its year. The few periods are broadcast."""
    table = F.broadcast(periods_table(series.sparkSession, periods))
    return series.join(table, F.col("year").between(F.col("first_year"), F.col("last_year"))).drop("first_year", "last_year")


def analyse_windows(series: DataFrame, keys: Sequence[str], config: WindowConfig) -> DataFrame:
    """keys, period, regime, threshold, k_trig, band_lo, band_hi, significant, k_trig_fixed, k_trig_thermo.

    All periods and regimes are one plan: days meet their periods, each (key, period) its two thresholds, and everything
    behind is grouped by key, period and regime.
    """
    if config.thermo_points not in ("fixed", "thermo"):
        raise ValueError(f"thermo_points is {config.thermo_points!r}; it can be fixed or thermo")
    keys = list(keys)
    days = in_periods(series.where(F.col("month").isin(*config.months)), config.periods)
    thermo = matched_thresholds(days, keys, "period", config.baseline, config.fixed_threshold).select(*keys, "period", "threshold")
    regimes = F.explode(F.array(F.struct(F.lit("fixed").alias("regime"), F.lit(float(config.fixed_threshold)).alias("threshold")), F.struct(F.lit("thermodynamic").alias("regime"), F.col("threshold"))))
    limits = thermo.select(*keys, "period", regimes.alias("r")).select(*keys, "period", "r.regime", "r.threshold")
    full = [*keys, "period", "regime", "threshold"]
    day = days.join(limits, [*keys, "period"]).withColumn("block", calendar_block(F.col("year"), F.col("month"), config.months) if config.year_blocked else F.lit(0))
    detect = config.detector or (lambda d, k, limit, n: flag_extremes(d, k, limit, n))
    marked = detect(day, full, F.col("threshold"), config.spell).withColumns({"a": F.col("event"), "b": F.col("event")})
    bands = coincidence.null_band(marked, full, config.delta, config.tau, False, config.null_model, *config.band)
    fixed = F.max(F.when(F.col("regime") == "fixed", F.col("k_trigg"))).over(Window.partitionBy(*keys, "period"))
    out = bands.withColumn("_kf", fixed)
    thermodynamic = F.col("regime") == "thermodynamic"
    shown = F.when(thermodynamic & F.lit(config.thermo_points == "fixed"), F.col("_kf")).otherwise(F.col("k_trigg"))
    return out.select(*full, shown.alias("k_trig"), "band_lo", "band_hi", (shown > F.col("band_hi")).cast("int").alias("significant"), F.when(thermodynamic, F.col("_kf")).alias("k_trig_fixed"), F.when(thermodynamic, F.col("k_trigg")).alias("k_trig_thermo"))


def rolling_coincidence(series: DataFrame, keys: Sequence[str], periods: Sequence[str], delta: int = 4, tau: int = 1, null_model: str = "pooled") -> DataFrame:
    """Self-coincidence of flagged days (column event) for each period."""
    days = in_periods(series, periods).withColumns({"a": F.col("event"), "b": F.col("event")})
    return coincidence.analyse(days, [*keys, "period"], delta, tau, False, null_model)
