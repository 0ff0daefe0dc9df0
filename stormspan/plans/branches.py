"""More queries over the shared tables: parameter branches, surrogates, sources, user functions, reports, with equal SQL."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stormspan.functions import calendar as cal
from stormspan.operators import coincidence, events, fields, flagging, stats, windows
from stormspan.plans import sweep
from stormspan.plans.queries import (
    AXIS,
    BASE,
    BASE_P,
    BASE_R,
    CDF,
    CLIM,
    COMPOSITE,
    DAILY,
    DATES,
    ER,
    FIELD,
    FOUND,
    MEMBERS,
    ORDERS,
    PAIR_AB,
    PERIOD,
    PERIODS,
    R,
    RATES,
    SELF,
    SWEEP,
    THRESHOLD,
    WINDOWED,
    WINDOW_CONFIG,
    _counts,
    daily,
    _dates,
    _flag,
    found,
    gridded,
    _marks,
    members,
    _p,
    pair_ab,
    _pmf,
    query,
    _rates,
    rounded,
    self_ab,
    _sessions,
    _sql,
    summer,
    wet,
    wet_region,
)
from stormspan.sources import io, netcdf

# --- surrogates and other branches of coincidence -----------------------------------------------------------------------


def _drawn(series: str, n: str) -> str:
    """Floyd's method: the positions of n events in a block of len(days) days."""
    draw = f"('0x' || substr(md5('42{series}' || '/' || region || '/' || block || '/' || r || '/' || x[1]), 1, 12))::BIGINT % x[1] + 1"
    steps = f"list_transform(CASE WHEN {n} > 0 THEN generate_series(len(days) - {n} + 1, len(days)) ELSE [] END, lambda j: [j::BIGINT])"
    fold = f"list_reduce(list_prepend([]::BIGINT[], {steps}), lambda h, x: list_append(h, CASE WHEN list_contains(h, {draw}) THEN x[1] ELSE {draw} END))"
    return f"list_transform({fold}, lambda i: days[i])"


SURROGATES = (
    "blk AS (SELECT region, block, list_sort(list(idx)) AS days, CAST(sum(a) AS BIGINT) AS na, CAST(sum(b) AS BIGINT) AS nb FROM ab GROUP BY ALL)",
    f"placed AS (SELECT region, block, r, {_drawn('a', 'na')} AS pa, {_drawn('b', 'nb')} AS pb FROM blk CROSS JOIN (SELECT unnest(generate_series(1, 50)) AS r))",
    "sur AS (SELECT region, r, sum(len(list_filter(pa, lambda x: len(list_filter(pb, lambda y: y - x BETWEEN -2 AND -1)) > 0))) AS kp, sum(len(list_filter(pb, lambda x: len(list_filter(pa, lambda y: y - x BETWEEN 1 AND 2)) > 0))) AS kt FROM placed GROUP BY ALL)",
)


@query(_sql(*BASE_P, PAIR_AB, _marks("region", 1, 1), _counts("region"), *SURROGATES, "SELECT region, CASE WHEN any_value(least(n_a, n_b)) > 0 THEN avg(CAST(kp / n_a > k_prec / n_a AS INT)) END AS pvalue_prec, CASE WHEN any_value(least(n_a, n_b)) > 0 THEN avg(CAST(kt / n_b > k_trigg / n_b AS INT)) END AS pvalue_trigg FROM sur JOIN tot USING (region) GROUP BY region"))
def eca_shuffle(spark, d):
    return coincidence.shuffle_test(pair_ab(spark, d), R, 1, 1, reps=50)


@query(_sql(*BASE_P, PAIR_AB, _marks("region", 4, 1), "SELECT region, coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (WHERE prec = 1), '') AS prec_indices, coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (WHERE trigg = 1), '') AS trigg_indices FROM m GROUP BY region"))
def eca_indices(spark, d):
    out = coincidence.indices(coincidence.marks(pair_ab(spark, d), R, 4, 1), R)
    return out.select("region", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("prec_indices", "trigg_indices")))


@query(_sql(ORDERS, AXIS, MEMBERS, f"ab AS (SELECT ensemble, region, 0 AS block, idx, CAST(coalesce(value > {THRESHOLD}, false) AS INT) AS a, CAST(coalesce(value > {THRESHOLD}, false) AS INT) AS b FROM members)", _marks("ensemble, region", 2, 3), _counts("ensemble, region"), f"SELECT ensemble, region, {RATES} FROM tot"))
def eca_contiguous(spark, d):
    """One block from end to end."""
    flags = flagging.flag_extremes(cal.with_blocks(members(spark, d), contiguous=True), ER, THRESHOLD)
    return _rates(coincidence.analyse(flags.withColumns({"a": F.col("event"), "b": F.col("event")}), ER, 2, 3, null_model=None), ER)


def _smallest(q: float) -> str:
    return f"CAST(list_position(list_transform(cdf, lambda x: x >= {q}), true) - 1 AS DOUBLE)"


@query(_sql(*BASE, SELF, _marks("ensemble, region", 1, 1), _counts("ensemble, region"), _pmf("pt", "tot", "ensemble, region", "n_b", _p("n_a", 1, 1)), f"c AS (SELECT ensemble, region, {CDF} FROM pt)", f"SELECT ensemble, region, k_trigg, {_smallest(0.025)} AS band_lo, {_smallest(0.975)} AS band_hi, CAST(k_trigg > {_smallest(0.975)} AS INT) AS significant FROM tot JOIN c USING (ensemble, region)"))
def eca_null_band_counts(spark, d):
    return coincidence.null_band(self_ab(spark, d), ER, 1, 1, interpolate=False)


SINGLE = "CAST(min(idx) AS INT) AS start_index, CAST(max(idx) AS INT) AS end_index, min(yyyymmdd) AS start_yyyymmdd, max(yyyymmdd) AS end_yyyymmdd, count(*) AS duration, CAST(max(idx) - min(idx) AS INT) AS length"


@query(_sql(*BASE, _sessions("s", "wet", "ensemble, region", 5), f"SELECT ensemble, region, block AS year, 'compound' AS event_type, {SINGLE} FROM s GROUP BY ensemble, region, block, session HAVING count(*) >= 2"))
def episode_stats_compound(spark, d):
    """Lengths without the last day, no single days, no list of days."""
    return events.episodes(wet(spark, d), ER, 4, 1, inclusive=False, singles=False, rain_days=False)


@query(_sql(ORDERS, AXIS, DAILY, "SELECT region, idx, round(threshold, 6) AS threshold FROM daily JOIN (SELECT region, quantile_cont(value, 0.9) AS threshold FROM daily WHERE year <= 1996 GROUP BY region) USING (region) WHERE value < threshold AND month IN (6, 7, 8, 9)"))
def flag_percentile_reference(spark, d):
    """Days below the percentile of other years."""
    series = daily(spark, d)
    out = flagging.flag_percentile(series, R, 90.0, series.where("year <= 1996"), direction="below")
    return rounded(out.where(F.col("event") == 1).where(cal.in_season(F.col("month"), 6, 4)).select("region", "idx", "threshold"), threshold=6)


@query(_sql(ORDERS, AXIS, DAILY, PERIOD, *WINDOWED, "SELECT w.region, w.period, w.regime, f.k_trigg AS k_trig, round(w.hi, 6) AS band_hi, CAST(f.k_trigg > w.hi AS INT) AS significant, CASE WHEN w.regime = 'thermodynamic' THEN w.k_trigg END AS k_trig_thermo FROM win w JOIN win f ON f.region = w.region AND f.period = w.period AND f.regime = 'fixed'"))
def window_analysis_fixed_points(spark, d):
    out = windows.analyse_windows(daily(spark, d), R, dataclasses.replace(WINDOW_CONFIG, thermo_points="fixed"))
    return rounded(out.select("region", "period", "regime", "k_trig", "band_hi", "significant", "k_trig_thermo"), band_hi=6)


@query(_sql(ORDERS, AXIS, DAILY, PERIOD, *WINDOWED, "SELECT CASE region WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Old Europe' ELSE region END AS \"Region\", CAST(sum(CASE WHEN period = '1999-2001' AND regime = 'fixed' AND k_trigg > hi THEN 1 ELSE 0 END) AS BIGINT) AS n FROM win GROUP BY region"))
def ensemble_agreement_names(spark, d):
    out = stats.agreement(windows.analyse_windows(daily(spark, d), R, WINDOW_CONFIG), PERIODS[0], PERIODS[2], {"ASIA": "Asia", "EUROPE": "Old Europe"})
    return out.select("Region", F.col(f"{PERIODS[2]} Fixed Threshold").alias("n"))


# --- statistics and reports -----------------------------------------------------------------------------------------------


@query(_sql(*FOUND, "e AS (SELECT *, start_idx % 12 + 1 AS m FROM ev), k AS (SELECT * FROM e WHERE m IN (11, 12, 1))", "SELECT ensemble, year, coalesce(n, 0) AS n_events, CAST(coalesce(td, 0) AS BIGINT) AS total_duration, round(md, 6) AS mean_duration, CAST(coalesce(xd, 0) AS BIGINT) AS max_duration FROM (SELECT DISTINCT ensemble FROM k) CROSS JOIN (SELECT DISTINCT year FROM k) LEFT JOIN (SELECT ensemble, year, count(*) AS n, sum(n_extreme_cases) AS td, avg(n_extreme_cases) AS md, max(n_extreme_cases) AS xd FROM k GROUP BY ALL) USING (ensemble, year)"))
def annual_stats_season(spark, d):
    """Events of a season that wraps the year, by a month column."""
    own = found(spark, d).withColumn("m", (F.col("start_idx") % 12 + 1).cast("int"))
    return rounded(stats.annual_stats(own, ["ensemble"], length=None, month="m", season=(11, 3)), mean_duration=6)


@query(_sql(*FOUND, "SELECT CAST(ensemble AS VARCHAR) AS ensemble, " + ", ".join(f"CAST(count(*) FILTER (WHERE year = {y}) AS BIGINT) AS \"{y}\"" for y in range(1995, 1999)) + " FROM ev GROUP BY ensemble"))
def counts_matrix(spark, d):
    """Member by year, 0 where there is nothing."""
    return stats.pivoted(stats.annual_counts(found(spark, d), ["ensemble"]), ["ensemble"], "year", "n", range(1995, 1999), 0)


@query(_sql(*FOUND, "g AS (SELECT ensemble, year, count(*) AS n FROM ev GROUP BY ALL)", "SELECT ensemble, year, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT ensemble FROM members) CROSS JOIN (SELECT unnest(generate_series(1994, 1999)) AS year) LEFT JOIN g USING (ensemble, year)"))
def counts_from_counts(spark, d):
    """The grid of counts from a table that has them already."""
    own = stats.annual_counts(found(spark, d), [*ER])
    out = stats.member_counts(own, members(spark, d), stats.year_range(spark, 1994, 1999), count="n")
    return out.select("ensemble", "year", "n")


@query(_sql(*FOUND, "SELECT region, block, CAST(start_idx AS INT) AS start_idx, ensemble, 'Member: ' || ensemble || '<br>Days: ' || length || '<br>Extreme: ' || n_extreme_cases AS hover FROM ev"))
def hover_texts(spark, d):
    out = stats.hover_text(found(spark, d), {"Member": "ensemble", "Days": "length", "Extreme": "n_extreme_cases"})
    return out.select("region", "block", "start_idx", "ensemble", "hover")


# --- sources and user functions -------------------------------------------------------------------------------------------


@query(_sql(ORDERS, AXIS, MEMBERS, "SELECT ensemble, region, idx, yyyymmdd, round(value, 6) AS value FROM members WHERE ensemble IN ('1-URGENT', '2-HIGH') AND region = 'ASIA' AND month IN (12, 1, 2) AND value IS NOT NULL"))
def series_source(spark, d):
    """Written and read again; members, regions and a wrapping season reach the scan."""
    path = io.scratch(spark, "series")
    io.write_series(members(spark, d).withColumn("variable", F.lit("price")), path)
    out = io.read_series(spark, path, ["1-URGENT", "2-HIGH"], ["ASIA"], (12, 3))
    return rounded(out.where("value IS NOT NULL").select(*ER, "idx", "yyyymmdd", "value"), value=6)


@query(_sql(ORDERS, AXIS, MEMBERS, "SELECT ensemble, region, idx, yyyymmdd, year, month, round(value, 6) AS value FROM members WHERE ensemble IN ('1-URGENT', '4-NOT SPECIFIED') AND region IN ('ASIA', 'MIDDLE EAST')"))
def netcdf_source(spark, d):
    """A classic NetCDF file for each member and region, written and read again."""
    path = io.scratch(spark, "netcdf")
    own = members(spark, d).where(F.col("ensemble").isin("1-URGENT", "4-NOT SPECIFIED") & F.col("region").isin("ASIA", "MIDDLE EAST"))
    netcdf.write_series(own.withColumn("variable", F.lit("price")), path)
    out = netcdf.read_series(spark, [path], r"ensemble=([^/]+)/region=([^/]+)/")
    return rounded(out.select(*ER, "idx", "yyyymmdd", "year", "month", F.when(~F.isnan("value"), F.col("value")).alias("value")), value=6)


@query("SELECT 'no member' AS ensemble, r_name AS region FROM region UNION ALL SELECT DISTINCT o_orderpriority, 'NOWHERE' FROM orders UNION ALL SELECT 'no member', 'NOWHERE'")
def missing_members(spark, d):
    names = sorted(r[0] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority").distinct().collect())
    regions = sorted(r[0] for r in spark.read.parquet(f"{d}/region.parquet").select("r_name").collect())
    return io.missing_members(members(spark, d), [*names, "no member"], [*regions, "NOWHERE"])


@query(_sql(*FOUND, "SELECT ensemble, region, block, CAST(start_idx AS INT) AS start_idx, n_extreme_cases FROM ev"))
def csv_sink(spark, d):
    path = io.scratch(spark, "csv")
    io.write_csv(found(spark, d).drop("year"), path, ["ensemble"])
    return spark.read.option("header", True).schema("region string, block int, start_idx int, end_idx int, length int, n_extreme_cases long, ensemble string").csv(path).select(*ER, "block", "start_idx", "n_extreme_cases")


@query(_sql(ORDERS, FIELD, "SELECT member, lat, lon, yyyymmdd, round(value / 100, 6) AS value FROM f WHERE member = '5-LOW' AND yyyymmdd IN ('19960105', '19970303', '19970304')"))
def fields_source(spark, d):
    """Two tables, each made ready by a function as it is read; only the wanted days."""
    path = io.scratch(spark, "fields")
    io.write_fields(gridded(spark, d).withColumn("units", F.lit("Pa")), path)
    days = io.date_selection(spark, {"5-LOW": ["1996-01-05", "1997/03/03", "19970304", "21000101"]}, [])
    out = io.read_fields(spark, [path], days, prepare=fields.converted)
    return rounded(out.select("member", "lat", "lon", "yyyymmdd", "value"), value=6)


@query(_sql(ORDERS, FIELD, "u AS (SELECT value, CASE lat WHEN 0 THEN 'Pa' WHEN 1 THEN 'kg m-2 s-1' ELSE 'K' END AS u FROM f)", "SELECT CASE u WHEN 'Pa' THEN 'hPa' WHEN 'kg m-2 s-1' THEN 'mm day-1' ELSE u END AS units, count(*) AS n, round(avg(CASE u WHEN 'Pa' THEN value / 100 WHEN 'kg m-2 s-1' THEN value * 86400 ELSE value END), 2) AS mean FROM u GROUP BY ALL"))
def unit_conversion(spark, d):
    own = gridded(spark, d).withColumn("units", F.when(F.col("lat") == 0, "Pa").when(F.col("lat") == 1, "kg m-2 s-1").otherwise("K"))
    return fields.converted(own).groupBy("units").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean"))


@query(_sql(ORDERS, FIELD, CLIM, "SELECT member, lat, lon, round(value, 6) AS value, n_days FROM cl"))
def climatology_cache(spark, d):
    """Built once, then read."""
    path, options = io.scratch(spark, "climatology"), {"first": "19950101", "last": "19991231", "months": (6, 7, 8)}
    fields.cached_climatology(gridded(spark, d), path, **options)
    return rounded(fields.cached_climatology(gridded(spark, d).limit(0), path, **options), value=6)


@query(_sql(*BASE, FIELD, DATES, COMPOSITE, "cd AS (SELECT member, substr(yyyymmdd, 5, 4) AS mmdd, lat, lon, avg(value) AS value FROM f WHERE yyyymmdd BETWEEN '19950101' AND '19991231' GROUP BY ALL)", "dd AS (SELECT cd.member, lat, lon, avg(cd.value) AS c FROM (SELECT DISTINCT member, yyyymmdd FROM f SEMI JOIN dt USING (member, yyyymmdd)) x JOIN cd ON cd.member = x.member AND cd.mmdd = substr(x.yyyymmdd, 5, 4) GROUP BY cd.member, lat, lon)", "SELECT co.member, co.lat, co.lon, round(co.value - dd.c, 8) AS value, co.n_days FROM co LEFT JOIN dd ON co.member = dd.member AND co.lat = dd.lat AND co.lon = dd.lon"))
def composite_anomaly_dayofyear(spark, d):
    """Against the mean climatology of the same days of the year."""
    clim = fields.climatology(gridded(spark, d), "19950101", "19991231", kind="dayofyear")
    return rounded(fields.anomaly(gridded(spark, d), _dates(spark, d), clim, "dayofyear"), value=8)


@query(_sql(ORDERS, AXIS, DAILY, "SELECT r_name AS \"Region\", r_regionkey AS lon, round(mean, 6) AS mean FROM region JOIN (SELECT region, avg(value) AS mean FROM daily GROUP BY region) ON region = r_name WHERE r_name <> 'AFRICA'"))
def regions_summary(spark, d):
    """Polygons of a GeoJSON file with the regions' statistics; a region without one of them is dropped."""
    path = io.scratch(spark, "regions")
    rows = spark.read.parquet(f"{d}/region.parquet").select("r_name", "r_regionkey").collect()
    shapes = [{"type": "Feature", "properties": {"geo_region": r.r_name}, "geometry": {"type": "Point", "coordinates": [int(r.r_regionkey), 0]}} for r in rows]
    spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": shapes}),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    summary = daily(spark, d).groupBy(F.col("region").alias("Region")).agg(F.avg("value").alias("mean")).withColumn("mean", F.when(F.col("Region") != "AFRICA", F.col("mean")))
    out = stats.join_regions(io.read_regions(spark, path), summary, columns=["mean"])
    return rounded(out.select("Region", F.get_json_object("geometry", "$.coordinates[0]").cast("int").alias("lon"), "mean"), mean=6)


def above(values: np.ndarray, spell: int, threshold: float) -> np.ndarray:
    return np.nan_to_num(values, nan=-np.inf) > threshold


@query(_sql(*BASE, f"SELECT ensemble, region, idx FROM members WHERE value > {THRESHOLD} AND month IN (6, 7, 8, 9)"))
def custom_detector(spark, d):
    """Flags from a function of an array, by series and block."""
    days = summer(members(spark, d)).where("block IS NOT NULL")
    return io.array_detector(above)(days, [*ER, "block"], THRESHOLD, 1).where("event = 1").select(*ER, "idx")


def longest_spell(days: pd.DataFrame) -> pd.DataFrame:
    """The longest run of flagged days; the earliest of equals."""
    at = days.loc[days["event"] == 1, "idx"].sort_values().to_numpy()
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    best = max(runs, key=len)
    return pd.DataFrame({"start_idx": best[:1], "length": [len(best)] * len(best[:1])})


@query(_sql(*BASE_R, "runs AS (SELECT *, idx - row_number() OVER (PARTITION BY region, block ORDER BY idx) AS run FROM wetr WHERE event = 1 AND block IS NOT NULL)", "sp AS (SELECT region, block, min(idx) AS s, count(*) AS n FROM runs GROUP BY region, block, run)", "SELECT region, block, CAST(s AS INT) AS start_idx, n AS length FROM (SELECT *, row_number() OVER (PARTITION BY region, block ORDER BY n DESC, s) AS k FROM sp) WHERE k = 1"))
def custom_events(spark, d):
    """An event table from a function of one block's days."""
    return io.table_detector(longest_spell, "start_idx int, length long")(wet_region(spark, d).where("block IS NOT NULL"), [*R, "block"])


# --- the batch analysis ---------------------------------------------------------------------------------------------------


def _sweep(one: str, *parts: str) -> str:
    """The union of a query over all thresholds and delays."""
    own = []
    for t in SWEEP.thresholds:
        for delta in SWEEP.deltas:
            pieces = ", ".join((_flag("wet", "members", f"value > {t}"), "ab AS (SELECT ensemble, region, block, idx, yyyymmdd, event, event AS a, event AS b FROM wet WHERE block IS NOT NULL)", *(p.replace("@delta", str(delta)).replace("@gap", str(delta + 1)) for p in parts)))
            own.append(f"SELECT * FROM (WITH {pieces} SELECT CAST({t} AS DOUBLE) AS wet_threshold, {delta} AS \"delT\", x.* FROM ({one}) x)")
    return _sql(ORDERS, AXIS, MEMBERS, " UNION ALL ".join(own))


EPISODES = "CASE WHEN count(*) >= 2 THEN 'compound' ELSE 'single' END AS event_type, CAST(min(idx) AS INT) AS start_index, CAST(max(idx) AS INT) AS end_index, count(*) AS duration"
GAP = "s AS (SELECT *, sum(nw) OVER (PARTITION BY {keys}, block ORDER BY idx) AS session FROM (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY {keys}, block ORDER BY idx) <= @gap THEN 0 ELSE 1 END AS nw FROM {source} WHERE event = 1 AND block IS NOT NULL))"


@query(_sweep(f"SELECT ensemble, region, block AS year, {EPISODES} FROM s GROUP BY ensemble, region, block, session", GAP.format(keys="ensemble, region", source="wet")))
def pipeline_regional_episodes(spark, d):
    out = sweep.run(members(spark, d), SWEEP)["regional_episodes"]
    return out.select("wet_threshold", "delT", *ER, "year", "event_type", "start_index", "end_index", "duration")


NATION = "nat AS (SELECT *, row_number() OVER (PARTITION BY ensemble ORDER BY yyyymmdd) - 1 AS idx, CAST(substr(yyyymmdd, 1, 4) AS INT) AS block FROM (SELECT ensemble, yyyymmdd, max(event) AS event FROM wet WHERE block IS NOT NULL GROUP BY ALL))"


@query(_sweep(f"SELECT ensemble, block AS year, {EPISODES} FROM s GROUP BY ensemble, block, session", NATION, GAP.format(keys="ensemble", source="nat")))
def pipeline_national_episodes(spark, d):
    out = sweep.run(members(spark, d), SWEEP)["national_episodes"]
    return out.select("wet_threshold", "delT", "ensemble", "year", "event_type", "start_index", "end_index", "duration")


W = "PARTITION BY ensemble, region, block ORDER BY idx RANGE BETWEEN"


@query(_sweep("SELECT ensemble, CASE WHEN max(c) = 1 THEN 'compound' WHEN max(event) = 1 THEN 'single' ELSE 'no events' END AS day_class, yyyymmdd FROM m GROUP BY ensemble, yyyymmdd", f"m AS (SELECT *, CAST(event = 1 AND (coalesce(max(event) OVER ({W} @gap PRECEDING AND 1 PRECEDING), 0) = 1 OR coalesce(max(event) OVER ({W} 1 FOLLOWING AND @gap FOLLOWING), 0) = 1) AS INT) AS c FROM ab)"))
def pipeline_day_classes(spark, d):
    """Written as CSV by member, threshold and delay, and read again."""
    path = io.scratch(spark, "sweep")
    sweep.run(members(spark, d), SWEEP, path)
    out = spark.read.option("header", True).schema("day_class string, yyyymmdd string, ensemble string, wet_threshold double, delT int").csv(f"{path}/events_by_day")
    return out.select("wet_threshold", "delT", "ensemble", "day_class", "yyyymmdd")
