"""Seasons, blocks and calendar labels as column expressions.

A daily series is a long table with a dense integer day position `idx` for each key, so position differences are day
differences; labels are yyyymmdd strings, which also hold dates of a 360-day calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_int(value: object, name: str, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} is {value!r}; it must be an integer of at least {least}")
    return value


def check_linkage(delta: int, tau: int) -> None:
    check_int(delta, "delta", 0)
    check_int(tau, "tau", 1)


def check_season(start: int, length: int) -> None:
    if not 1 <= check_int(start, "season start", 1) <= 12 or not 1 <= check_int(length, "season length", 1) <= 12:
        raise ValueError(f"season ({start}, {length}) isn't within 1 to 12")


def season_months(start: int, length: int) -> tuple[int, ...]:
    """Months of a season, wrapping around the year: (10, 5) is October to February."""
    check_season(start, length)
    return tuple((start - 1 + k) % 12 + 1 for k in range(length))


def in_season(month: Column, start: int, length: int) -> Column:
    return month.isin(*season_months(start, length))


def season_year(year: Column, month: Column, start: int) -> Column:
    """The year in which the season that a month belongs to begins."""
    return F.when(month >= start, year).otherwise(year - 1)


def season_block(year: Column, month: Column, start: int, length: int) -> Column:
    """Season year of days in season, else null."""
    return F.when(in_season(month, start, length), season_year(year, month, start))


def calendar_block(year: Column, month: Column, months: Sequence[int] = (6, 7, 8, 9)) -> Column:
    """Calendar year of days in the given months, else null."""
    return F.when(month.isin(*months), year)


def with_blocks(series: DataFrame, start: int = 1, length: int = 12, months: bool = True, contiguous: bool = False) -> DataFrame:
    """Adds `block`: a number for each season, or 0 everywhere (contiguous). Without months a block is a calendar year, which only a season that doesn't wrap allows."""
    if contiguous:
        return series.withColumn("block", F.lit(0))
    if not months:
        if start + length - 1 > 12:
            raise ValueError("a season that wraps the year needs months")
        return series.withColumn("block", F.col("year"))
    return series.withColumn("block", season_block(F.col("year"), F.col("month"), start, length))


def run_blocks(series: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Adds `block`: runs of equal labels in the order of idx."""
    w = Window.partitionBy(*keys).orderBy("idx")
    new = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(0))
    return series.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def periods_table(spark, periods: Sequence[str]) -> DataFrame:
    """period, first_year, last_year (both included) of labels such as 1980-2010."""
    rows = [(p, int(p.split("-")[0]), int(p.split("-")[1])) for p in periods]
    return spark.createDataFrame(rows, "period string, first_year int, last_year int")


def date_label(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def month_day(label: Column) -> Column:
    return F.substring(label, 5, 4)


def normal_label(text: Column) -> Column:
    """yyyymmdd of a date with or without -, / or spaces; anything else raises an error."""
    plain = F.regexp_replace(text, "[-/ ]", "")
    good = plain.rlike("^[0-9]{8}$") & F.substring(plain, 5, 2).between("01", "12") & F.substring(plain, 7, 2).between("01", "31")
    return F.when(text.isNull() | good, plain).otherwise(F.raise_error(F.concat(F.lit("not a date: "), text)).cast("string"))


def shift_360(label: Column, days: int | Column) -> Column:
    """A label some days later (or earlier) in the calendar of twelve months of 30 days."""
    y, m, d = (F.substring(label, a, n).cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
    t = y * 360 + (m - 1) * 30 + (d - 1) + (F.lit(days) if isinstance(days, int) else days)
    parts = F.floor(t / 360), F.floor(F.pmod(t, F.lit(360)) / 30) + 1, F.pmod(t, F.lit(30)) + 1
    return F.concat(*[F.lpad(x.cast("int").cast("string"), n, "0") for x, n in zip(parts, (4, 2, 2), strict=True)])


def dense_axis(sparse: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """keys, idx, yyyymmdd, year, month, value: every key on every day from the first to the last of the whole table; days without a row have a null value.

    The axis is generated from two aggregated dates; only it is broadcast, one row for each day.
    """
    ends = sparse.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    axis = ends.where("lo IS NOT NULL").select("lo", F.explode(F.sequence("lo", "hi")).alias("_d")).select(F.col("_d"), F.datediff("_d", "lo").alias("idx"))
    grid = sparse.select(*keys).distinct().join(F.broadcast(axis), F.lit(True))
    full = grid.join(sparse.select(*keys, F.col(day).alias("_d"), F.col(value).alias("value")), [*keys, "_d"], "left")
    return full.select(*keys, "idx", date_label(F.col("_d")).alias("yyyymmdd"), F.year("_d").alias("year"), F.month("_d").alias("month"), F.when(~F.isnan("value"), F.col("value")).alias("value"))
