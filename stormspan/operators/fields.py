"""Gridded fields in long form (member, yyyymmdd, lat, lon, value): climatologies, composites, ensemble agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormspan.functions.calendar import month_day, shift_360

CELL = ["lat", "lon"]


def in_box(fields: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Cells in a box; longitudes are compared in [-180, 180), and a box may cross that border."""
    at = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180
    west, east = ((x + 180) % 360 - 180 for x in lon)
    inside = at.between(west, east) if west <= east else (at >= west) | (at <= east)
    return fields.where(inside & F.col("lat").between(*lat))


def converted(fields: DataFrame) -> DataFrame:
    """Pa to hPa, and kg m-2 s-1 to mm/day, by the column units."""
    unit = F.col("units")
    return fields.withColumns({"value": F.when(unit == "Pa", F.col("value") / 100).when(unit == "kg m-2 s-1", F.col("value") * 86400).otherwise(F.col("value")), "units": F.when(unit == "Pa", "hPa").when(unit == "kg m-2 s-1", "mm day-1").otherwise(unit)})


def selected_dates(dates: DataFrame, months: Sequence[int] | None = None, years: tuple[int, int] | None = None, lag: int = 0) -> DataFrame:
    """member, yyyymmdd: well-formed dates of the months and years, each once, then moved by lag days of the 360-day calendar."""
    label = F.col("yyyymmdd")
    kept = dates.where(label.rlike("^[0-9]{8}$"))
    if months is not None:
        kept = kept.where(F.substring(label, 5, 2).cast("int").isin(*months))
    if years is not None:
        kept = kept.where(F.substring(label, 1, 4).cast("int").between(*years))
    return kept.select("member", shift_360(label, lag).alias("yyyymmdd")).distinct()


def climatology(fields: DataFrame, first: str, last: str, months: Sequence[int] | None = None, kind: str = "period_mean") -> DataFrame:
    """Mean of each member's cell over the period (kind period_mean, with n_days), or for each day of the year (dayofyear, with mmdd)."""
    days = fields.where(F.col("yyyymmdd").between(first, last))
    if months is not None:
        days = days.where(F.substring("yyyymmdd", 5, 2).cast("int").isin(*months))
    if kind == "period_mean":
        return days.groupBy("member", *CELL).agg(F.avg("value").alias("value"), F.count_distinct("yyyymmdd").alias("n_days"))
    if kind == "dayofyear":
        return days.groupBy("member", month_day(F.col("yyyymmdd")).alias("mmdd"), *CELL).agg(F.avg("value").alias("value"))
    raise ValueError(f"kind is {kind!r}; it can be period_mean or dayofyear")


def cached_climatology(fields: DataFrame, path: str, rebuild: bool = False, **options: object) -> DataFrame:
    """climatology, kept as Parquet at path and read from there if it exists."""
    spark = fields.sparkSession
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except Exception as error:  # only a missing table is built
            if "PATH_NOT_FOUND" not in str(error):
                raise
    climatology(fields, **options).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def composite(fields: DataFrame, dates: DataFrame) -> DataFrame:
    """member, lat, lon, value, n_days: the mean field over a member's dates that are in the data."""
    wanted = fields.join(dates.select("member", "yyyymmdd").distinct(), ["member", "yyyymmdd"], "left_semi")
    return wanted.groupBy("member", *CELL).agg(F.avg("value").alias("value"), F.count_distinct("yyyymmdd").alias("n_days"))


def day_climatology(clim: DataFrame, days: DataFrame) -> DataFrame:
    """Mean of the dayofyear climatologies of days (repeats count), days without one passed over."""
    return days.select("member", month_day(F.col("yyyymmdd")).alias("mmdd")).join(clim, ["member", "mmdd"]).groupBy("member", *CELL).agg(F.avg("value").alias("value"))


def anomaly(fields: DataFrame, dates: DataFrame, clim: DataFrame, kind: str = "period_mean") -> DataFrame:
    """composite minus the climatology; both are reduced to a field for each member before they meet."""
    mean = composite(fields, dates)
    if kind == "dayofyear":
        found = fields.select("member", "yyyymmdd").distinct().join(dates.select("member", "yyyymmdd").distinct(), ["member", "yyyymmdd"], "left_semi")
        clim = day_climatology(clim, found)
    base = clim.select("member", *CELL, F.col("value").alias("_c"))
    return mean.join(base, ["member", *CELL], "left").select("member", *CELL, (F.col("value") - F.col("_c")).alias("value"), "n_days")


def missing_dates(fields: DataFrame, dates: DataFrame) -> DataFrame:
    """member, yyyymmdd of wanted days that the data lacks."""
    return dates.select("member", "yyyymmdd").distinct().join(fields.select("member", "yyyymmdd").distinct(), ["member", "yyyymmdd"], "left_anti")


def ensemble_mean(members: DataFrame) -> DataFrame:
    """lat, lon, value: member fields weighted by their share of days; a missing value adds nothing and the weights stay."""
    total = members.groupBy("member").agg(F.max("n_days").alias("_n")).agg(F.sum("_n").alias("_total"))
    weighted = F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(0.0)) * F.col("n_days") / F.col("_total")
    return members.join(F.broadcast(total), F.lit(True)).groupBy(*CELL).agg(F.sum(weighted).alias("value"))


def sign_agreement(members: DataFrame, share: float = 0.8) -> DataFrame:
    """lat, lon, value (ensemble mean), n_agree, fraction, agrees: members with the sign of the mean, against max(2, ceil(share * members))."""
    mean = ensemble_mean(members).withColumnRenamed("value", "_mean")
    count = members.agg(F.count_distinct("member").alias("_m"))
    cells = members.join(mean, CELL).groupBy(*CELL).agg(F.first("_mean").alias("value"), F.count_if(F.signum("value") == F.signum("_mean")).alias("n_agree"))
    least = F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("_m") - 1e-9))
    return cells.join(F.broadcast(count), F.lit(True)).select(*CELL, "value", "n_agree", (F.col("n_agree") / F.col("_m")).alias("fraction"), (F.col("n_agree") >= least).alias("agrees"))


def diagnostics(agreed: DataFrame) -> DataFrame:
    """One row: least and largest value, percent of cells beyond 1 and of agreeing cells, and the 1st and 99th percentile."""
    return agreed.agg(F.min("value").alias("least"), F.max("value").alias("largest"), (F.avg((F.abs("value") > 1).cast("double")) * 100).alias("percent_beyond_1"), (F.avg(F.col("agrees").cast("double")) * 100).alias("percent_agreeing"), F.percentile("value", 0.01).alias("p01"), F.percentile("value", 0.99).alias("p99"))
