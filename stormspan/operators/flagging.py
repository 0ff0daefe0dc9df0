"""Extreme-day flags of daily series (keys, idx, ..., value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormspan.functions.calendar import check_int


def is_extreme(value: Column, threshold: float | Column, direction: str = "above") -> Column:
    """Strictly above (below) the threshold; missing and NaN values never are."""
    if direction not in ("above", "below"):
        raise ValueError(f"direction is {direction!r}; it can be above or below")
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(~F.isnan(value) & (value > limit if direction == "above" else value < limit), F.lit(False))


def spell_starts(series: DataFrame, keys: Sequence[str], n: int, least: int) -> DataFrame:
    """keys and the first day of each of the windows of n days with at least `least` extreme ones (column _ex) that a scan takes which, after a hit, goes on behind the window.

    Starts that are n or more days apart don't influence each other, so the scan runs over short groups of near starts.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    ahead = w.rowsBetween(0, n - 1)
    fits = series.select(*keys, "idx", F.sum("_ex").over(ahead).alias("_n"), F.count("*").over(ahead).alias("_len")).where((F.col("_n") >= least) & (F.col("_len") == n))
    near = fits.select(*keys, "idx", F.coalesce((F.col("idx") - F.lag("idx").over(w) >= n).cast("int"), F.lit(1)).alias("_new"))
    grouped = near.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_g").agg(F.array_sort(F.collect_list("idx")).alias("_s"))
    taken = f"aggregate(_s, named_struct('last', cast(null as int), 'hits', cast(array() as array<int>)), (a, x) -> if(a.last IS NULL OR x >= a.last + {n}, named_struct('last', x, 'hits', concat(a.hits, array(x))), a), a -> a.hits)"
    return grouped.select(*keys, F.explode(F.expr(taken)).alias("start"))


def flag_extremes(series: DataFrame, keys: Sequence[str], threshold: float | Column, n: int = 1, min_days: int | None = None, direction: str = "above", flag: str = "last") -> DataFrame:
    """series with `event` (0/1), or for flag `combined` with event_first, event_all and event_last.

    A spell is n days with at least min_days (default n) extreme ones. flag: the day of a spell that is marked, `first`,
    `last`, or `all` of its extreme days. Give the block among the keys to keep spells within it.
    """
    check_int(n, "n", 1)
    least = n if min_days is None else check_int(min_days, "min_days", 1)
    if least > n:
        raise ValueError("min_days is more than n")
    if flag not in ("first", "last", "all", "combined"):
        raise ValueError(f"flag is {flag!r}; it can be first, last, all or combined")
    base = series.withColumn("_ex", is_extreme(F.col("value"), threshold, direction).cast("int"))
    names = ["event_first", "event_all", "event_last"] if flag == "combined" else ["event"]
    if n == 1:
        return base.withColumns({c: F.col("_ex") for c in names}).drop("_ex")
    starts = spell_starts(base, keys, n, least)
    days = starts.select(*keys, "start", F.explode(F.sequence("start", F.col("start") + n - 1)).alias("idx"))
    marks = days.select(*keys, "idx", (F.col("idx") == F.col("start")).alias("_f"), (F.col("idx") == F.col("start") + n - 1).alias("_l"))
    joined = base.join(marks, [*keys, "idx"], "left")
    first, last, every = (F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("_f"), F.col("_l"), F.col("_f").isNotNull() & (F.col("_ex") == 1)))
    made = {"event_first": first, "event_all": every, "event_last": last} if flag == "combined" else {"event": {"first": first, "last": last, "all": every}[flag]}
    return joined.withColumns(made).drop("_ex", "_f", "_l")


def percentile_thresholds(reference: DataFrame, keys: Sequence[str], percent: float) -> DataFrame:
    """keys and threshold: the linearly interpolated percentile of the values."""
    return reference.groupBy(*keys).agg(F.percentile("value", percent / 100).alias("threshold"))


def flag_percentile(series: DataFrame, keys: Sequence[str], percent: float, reference: DataFrame | None = None, **options: object) -> DataFrame:
    """flag_extremes against each key's own percentile of the reference (default: the series); adds `threshold`."""
    limits = percentile_thresholds(series if reference is None else reference, keys, percent)
    return flag_extremes(series.join(limits, list(keys), "left"), keys, F.col("threshold"), **options)


def compare_flags(series: DataFrame, keys: Sequence[str], threshold: float, n: int, min_days: int | None = None, direction: str = "above", show: int | None = None) -> DataFrame:
    """keys, idx, value, extreme, last, first, all; with `show` only so many days from a quarter of it before the first flag on."""
    out = flag_extremes(series, keys, threshold, n, min_days, direction, "combined")
    out = out.select(*keys, "idx", "value", is_extreme(F.col("value"), threshold, direction).cast("int").alias("extreme"), F.col("event_last").alias("last"), F.col("event_first").alias("first"), F.col("event_all").alias("all"))
    if show is None:
        return out
    first = out.groupBy(*keys).agg(F.min(F.when((F.col("first") == 1) | (F.col("last") == 1) | (F.col("all") == 1), F.col("idx"))).alias("_at"))
    low = F.greatest(F.coalesce(F.col("_at") - show // 4, F.lit(0)), F.lit(0))
    return out.join(first, list(keys)).where((F.col("idx") >= low) & (F.col("idx") < low + show)).drop("_at")


def percentile_rank(values: DataFrame, keys: Sequence[str], value: float) -> DataFrame:
    """keys and rank: the percentile rank (kind `rank`) of a value among the values."""
    v, q = F.col("value"), F.lit(float(value))
    strict, weak = F.count_if(v < q), F.count_if(v <= q)
    return values.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg((50.0 * (strict + weak + F.when(weak > strict, 1).otherwise(0)) / F.count("*")).alias("rank"))


def matched_thresholds(values: DataFrame, keys: Sequence[str], period: str, baseline: str, fixed: float) -> DataFrame:
    """keys, period, base_rank and threshold: each period's value at the percentile rank that `fixed` has in the baseline period."""
    base = percentile_rank(values.where(F.col(period) == baseline), keys, fixed).withColumnRenamed("rank", "base_rank")
    known = values.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, period, "value")
    group = Window.partitionBy(*keys, period)
    placed = known.withColumns({"_i": F.row_number().over(group.orderBy("value")) - 1, "_n": F.count("*").over(group)}).join(base, list(keys))
    at = (F.col("_n") - 1) * F.col("base_rank") / 100
    low = F.floor(at)
    near = placed.withColumns({"_low": low, "_part": at - low}).where(F.col("_i").between(F.col("_low"), F.col("_low") + 1))
    value = F.max(F.when(F.col("_i") == F.col("_low"), F.col("value")))
    upper = F.max("value")  # of one or two neighbours in order
    return near.groupBy(*keys, period, "base_rank").agg((value + (upper - value) * F.max("_part")).alias("threshold"))
