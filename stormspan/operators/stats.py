"""Statistics of events by year, member and region, with grids completed by zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormspan.functions.calendar import in_season, season_year
from stormspan.operators import events as ev


def grid(events: DataFrame, by: Sequence[str], years: DataFrame | None = None) -> DataFrame:
    """Every found combination of `by` with every year (found ones, or a table of them). Both are distinct rows, so the year side is broadcast."""
    span = (events.select("year") if years is None else years.select("year")).distinct()
    return F.broadcast(span) if not by else events.select(*by).distinct().join(F.broadcast(span), F.lit(True))


def year_range(spark, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def annual_stats(events: DataFrame, by: Sequence[str] = (), years: DataFrame | None = None, duration: str | None = "n_extreme_cases", length: str | None = "length", month: str | None = None, season: tuple[int, int] = (1, 12)) -> DataFrame:
    """by, year, n_events and total, mean and maximum of duration and length; years without events have zeros and null means."""
    if month is not None:
        events = events.where(in_season(F.col(month), *season))
    parts: list[Column] = [F.count("*").alias("n_events")]
    zero = ["n_events"]
    for name, col in (("duration", duration), ("length", length)):
        if col is not None:
            parts += [F.sum(col).alias(f"total_{name}"), F.avg(col).alias(f"mean_{name}"), F.max(col).cast("long").alias(f"max_{name}")]
            zero += [f"total_{name}", f"max_{name}"]
    full = grid(events, by, years).join(events.groupBy(*by, "year").agg(*parts), [*by, "year"], "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})


def annual_stats_by_variable(tables: dict[str, DataFrame], by: Sequence[str] = (), **options: object) -> DataFrame:
    """annual_stats of each named table, each over its own grid, with the column variable."""
    if not tables:
        raise ValueError("there is no table")
    out = None
    for name, events in tables.items():
        own = annual_stats(events, by, **options).select(F.lit(name).alias("variable"), "*")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def flag_annual_stats(series: DataFrame, keys: Sequence[str], min_duration: int = 1, season: tuple[int, int] = (6, 4), years: DataFrame | None = None) -> DataFrame:
    """annual_stats of maximal runs of flagged days, by the (season) year of their first day."""
    first = series.select(*keys, F.col("idx").alias("start_idx"), season_year(F.col("year"), F.col("month"), season[0]).alias("year"))
    runs = ev.spells(series, keys).where(F.col("length") >= min_duration).join(first, [*keys, "start_idx"])
    return annual_stats(runs, keys, years, duration="length", length="length")


def hovmoller(events: DataFrame, by: Sequence[str] = ("ensemble",), extras: Sequence[str] = (), years: DataFrame | None = None) -> DataFrame:
    """by, year, n_events, n_extreme_cases, max_duration, mean_duration, durations (in the order of events), mean_length and summed extras."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start_idx", "n_extreme_cases"))), lambda x: x.n_extreme_cases)
    agg = events.groupBy(*by, "year").agg(F.count("*").alias("n_events"), F.sum("n_extreme_cases").alias("n_extreme_cases"), F.max("n_extreme_cases").cast("long").alias("max_duration"), F.avg("n_extreme_cases").alias("mean_duration"), listed.alias("durations"), F.avg("length").alias("mean_length"), *(F.sum(c).alias(c) for c in extras))
    full = grid(events, by, years).join(agg, [*by, "year"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_events", "n_extreme_cases", "max_duration", *extras)}
    return full.withColumns(zero | {"durations": F.coalesce("durations", F.array().cast("array<bigint>"))})


def ensemble_summary(events: DataFrame, member: str = "ensemble") -> DataFrame:
    """year, mean, min, max, median and n_members (with events) of event counts over all members that have any event."""
    counts = grid(events, [member]).join(events.groupBy(member, "year").agg(F.count("*").alias("n")), [member, "year"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return counts.groupBy("year").agg(F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"), F.median("n").alias("median"), F.count_if(F.col("n") > 0).alias("n_members"))


def annual_counts(events: DataFrame, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """by, year, n: years without events are absent. count: a column of counts, if the table holds these and not events."""
    return events.groupBy(*by, "year").agg((F.sum(count) if count else F.count("*")).alias("n"))


def member_counts(events: DataFrame, members: DataFrame, years: DataFrame, member: str = "ensemble", count: str | None = None) -> DataFrame:
    """member, year, n over all given members and years; members without events count."""
    full = members.select(member).distinct().join(F.broadcast(years.select("year").distinct()), F.lit(True))
    return full.join(annual_counts(events, [member], count), [member, "year"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def rolling_mean(counts: DataFrame, by: Sequence[str], window: int, whole: bool, value: str = "n", name: str = "rolling") -> DataFrame:
    """Adds a centred mean over `window` rows in the order of years; whole: null where the window isn't full."""
    w = Window.partitionBy(*by).orderBy("year").rowsBetween(-(window // 2), (window - 1) // 2)
    mean = F.avg(value).over(w)
    return counts.withColumn(name, F.when(F.count(value).over(w) >= window, mean) if whole else mean)


def spread(events: DataFrame, members: DataFrame, years: DataFrame, window: int = 10, member: str = "ensemble") -> DataFrame:
    """year and the mean over members of their rolling mean counts."""
    rolled = rolling_mean(member_counts(events, members, years, member), [member], window, False)
    return rolled.groupBy("year").agg(F.avg("rolling").alias("mean_rolling"), F.min("n").alias("min"), F.max("n").alias("max"))


def duration_matrix(events: DataFrame, duration: str = "n_extreme_cases") -> DataFrame:
    """duration, year, n: counts for every duration from 0 to the longest and every year with events."""
    longest = events.agg(F.max(duration).alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("duration"))
    cells = longest.join(F.broadcast(events.select("year").distinct()), F.lit(True))
    return cells.join(events.groupBy(F.col(duration).cast("long").alias("duration"), "year").agg(F.count("*").alias("n")), ["duration", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def regional_means(events: DataFrame, region: str = "region", member: str = "ensemble") -> DataFrame:
    """region, year, mean_cases: flagged days by year, averaged over the members with events in the region, 0 where a region has none."""
    per = events.groupBy(region, member, "year").agg(F.sum("n_extreme_cases").alias("n"))
    members = events.groupBy(region).agg(F.count_distinct(member).alias("_m"))
    cells = grid(events, [region]).join(per.groupBy(region, "year").agg(F.sum("n").alias("n")), [region, "year"], "left").join(members, region)
    return cells.select(region, "year", (F.coalesce("n", F.lit(0)) / F.col("_m")).alias("mean_cases"))


def member_order(events: DataFrame, member: str = "ensemble", by: Sequence[str] = ()) -> DataFrame:
    """member, total, place: members by their number of events, fewest first, ties by name. One row for each member, so the window is small."""
    totals = events.groupBy(*by, member).agg(F.count("*").alias("total"))
    return totals.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("total", member)))


def agreement(windows: DataFrame, baseline: str, future: str, names: dict[str, str] | None = None) -> DataFrame:
    """Region and the number of members that are significant in the baseline (fixed) and the future period (fixed and thermodynamic)."""

    def hits(period: str, regime: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("period") == period) & (F.col("regime") == regime), F.col("significant"))), F.lit(0)).cast("long")

    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("region")), F.col("region")) if names else F.col("region")
    out = windows.groupBy("region").agg(hits(baseline, "fixed").alias(f"{baseline} Fixed Threshold"), hits(future, "fixed").alias(f"{future} Fixed Threshold"), hits(future, "thermodynamic").alias(f"{future} Thermo Threshold"))
    return out.select(shown.alias("Region"), *[f"`{c}`" for c in out.columns[1:]])


def join_regions(regions: DataFrame, summary: DataFrame, key: str = "geo_region", columns: Sequence[str] = ()) -> DataFrame:
    """Region polygons with their summary; rows that lack one of the columns are dropped."""
    return regions.join(summary, F.col(key) == F.col("Region")).dropna(subset=list(columns) or None)


def pivoted(cells: DataFrame, rows: Sequence[str], column: str, value: str, columns: Sequence[object], empty: object = None) -> DataFrame:
    """A matrix: rows, and a column for each of the given values of `column`; cells that aren't there hold `empty`."""
    out = cells.groupBy(*rows).pivot(column, list(columns)).agg(F.first(value))
    return out if empty is None else out.fillna(empty, [str(c) for c in columns])


def hover_text(table: DataFrame, shown: dict[str, str], name: str = "hover") -> DataFrame:
    """Adds a text of lines `label: value` (values that are missing are left out) for the labels and columns given."""
    lines = [F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in shown.items()]
    return table.withColumn(name, F.concat_ws("<br>", *lines))
