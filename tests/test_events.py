"""Flags, coincidence and events: worked examples and random series against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormspan.functions import calendar as cal
from stormspan.operators import coincidence, events, flagging, stats
from stormspan.plans import sweep
from stormspan.sources import io

EXAMPLE = [0, 1, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 1]


def series(spark, flags, key="k", block=0):
    rows = [(key, block, i, f"2000{i // 28 + 1:02d}{i % 28 + 1:02d}", int(x)) for i, x in enumerate(flags)]
    return spark.createDataFrame(rows, "key string, block int, idx int, yyyymmdd string, event int")


def test_worked_example(spark):
    found = events.episodes(series(spark, EXAMPLE), ["key"], 4, 1).orderBy("start_index").collect()
    assert [(r.event_type, r.start_index, r.end_index, r.duration, r.length) for r in found] == [("compound", 1, 7, 4, 7), ("single", 13, 13, 1, 1)]
    assert sorted(r.idx for r in events.membership(series(spark, EXAMPLE), ["key"], 4, 1).collect()) == [1, 4, 5, 7]
    assert events.compound_events(series(spark, EXAMPLE), ["key"], 5, 1).first().n_extreme_cases == 5


def test_lone_days_are_no_events(spark):
    assert events.compound_events(series(spark, [0, 1, 0]), ["key"], min_duration=1).count() == 0


def test_seasons():
    assert cal.season_months(8, 2) == (8, 9)
    assert cal.season_months(10, 5) == (10, 11, 12, 1, 2)
    for bad in ((0, 3), (13, 1), (5, 0), (5, 13)):
        with pytest.raises(ValueError):
            cal.season_months(*bad)


def test_season_years_and_shift(spark):
    df = spark.createDataFrame([(1980, 10, "19800625"), (1981, 2, "19801230"), (1981, 5, "20000101")], "year int, month int, label string")
    got = df.select(cal.season_block(F.col("year"), F.col("month"), 10, 5).alias("b"), cal.shift_360(F.col("label"), 10).alias("s"), cal.shift_360(F.col("label"), -1).alias("m")).collect()
    assert [tuple(r) for r in got] == [(1980, "19800705", "19800624"), (1980, "19810110", "19801229"), (None, "20000111", "19991230")]


def greedy(ex, n, least):
    hits, i = [], 0
    while i + n <= len(ex):
        if sum(ex[i : i + n]) >= least:
            hits.append(i)
            i += n
        else:
            i += 1
    return hits


@pytest.mark.parametrize(("n", "least"), [(2, 2), (3, 2), (4, 3), (15, 11)])
def test_spells(spark, n, least):
    rng = random.Random(n)
    values = [[rng.random() if rng.random() > 0.05 else None for _ in range(200)] for _ in range(3)]
    df = spark.createDataFrame([(str(k), i, v) for k, vs in enumerate(values) for i, v in enumerate(vs)], "key string, idx int, value double")
    got = flagging.flag_extremes(df, ["key"], 0.35, n, least, flag="combined").collect()
    for k, vs in enumerate(values):
        ex = [int(v is not None and v > 0.35) for v in vs]
        hits = greedy(ex, n, least)
        inside = {d for h in hits for d in range(h, h + n)}
        own = {r.idx: r for r in got if r.key == str(k)}
        assert [i for i in range(200) if own[i].event_first] == hits
        assert [i for i in range(200) if own[i].event_last] == [h + n - 1 for h in hits]
        assert [i for i in range(200) if own[i].event_all] == sorted(d for d in inside if ex[d])


def test_nan_is_never_extreme(spark):
    df = spark.createDataFrame([("k", 0, float("nan")), ("k", 1, 30.0), ("k", 2, None)], "key string, idx int, value double")
    assert [r.event for r in flagging.flag_extremes(df, ["key"], 20.0).orderBy("idx").collect()] == [0, 1, 0]
    assert [r.event for r in flagging.flag_extremes(df, ["key"], 40.0, direction="below").orderBy("idx").collect()] == [0, 1, 0]


def pairs(a, b, delta, tau, sym):
    more = delta if sym else 0
    prec = [s for s, x in enumerate(a) if x and any(0 <= j < len(b) and b[j] for j in range(s - tau - delta, s - tau + more + 1))]
    trigg = [s for s, x in enumerate(b) if x and any(0 <= j < len(a) and a[j] for j in range(s + tau - more, s + tau + delta + 1))]
    return prec, trigg


@pytest.mark.parametrize(("delta", "tau", "sym"), [(4, 1, False), (2, 0, False), (3, 3, True), (0, 0, True)])
def test_coincidence(spark, delta, tau, sym):
    rng = random.Random(delta)
    blocks = [([int(rng.random() < 0.2) for _ in range(60)], [int(rng.random() < 0.15) for _ in range(60)]) for _ in range(4)]
    rows = [("k", k, k * 60 + i, a[i], b[i]) for k, (a, b) in enumerate(blocks) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, block int, idx int, a int, b int")
    want = [pairs(a, b, delta, tau, sym) for a, b in blocks]
    for model in ("pooled", "blocked"):
        r = coincidence.analyse(df, ["key"], delta, tau, sym, model).first()
        assert (r.k_prec, r.k_trigg) == (sum(len(p) for p, _ in want), sum(len(t) for _, t in want))
        p_of = lambda t, n, d=delta: 1 - (1 - ((2 * d + 1) / t if sym else (d + 1) / (t - tau))) ** n
        pmf = [1.0]
        for t, n, m in [(240, r.n_b, r.n_a)] if model == "pooled" else [(60, sum(b), sum(a)) for a, b in blocks]:
            p = p_of(t, m)
            own = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
            pmf = [sum(pmf[j] * own[i - j] for j in range(len(pmf)) if 0 <= i - j < len(own)) for i in range(len(pmf) + len(own) - 1)]
        assert r.pvalue_trigg == pytest.approx(sum(pmf[r.k_trigg :]), rel=1e-9)


def test_no_events(spark):
    df = series(spark, [0] * 20).withColumns({"a": F.col("event"), "b": F.col("event")})
    r = coincidence.analyse(df, ["key"], alpha=0.05).first()
    assert (r.n_a, r.rate_prec, r.pvalue_prec, r.null_prec) == (0, None, None, False)
    band = coincidence.null_band(df, ["key"]).first()
    assert (band.k_trigg, band.band_lo, band.band_hi, band.significant) == (0, 0.0, 0.0, 0)


def test_bad_flags_raise(spark):
    df = series(spark, [0, 2]).withColumns({"a": F.col("event"), "b": F.col("event")})
    with pytest.raises(Exception, match="0 and 1"):
        coincidence.analyse(df, ["key"]).collect()


@pytest.mark.parametrize(("delta", "tau"), [(2, 2), (3, 1), (1, 4), (0, 1)])
def test_components(spark, delta, tau):
    rng = random.Random(delta * 10 + tau)
    flags = [int(rng.random() < 0.35) for _ in range(120)]
    at = [i for i, x in enumerate(flags) if x]
    root = {i: i for i in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in at:
        for j in at:
            if tau <= j - i <= tau + delta:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in at:
        groups.setdefault(find(i), []).append(i)
    want = sorted((min(g), max(g), len(g)) for g in groups.values() if len(g) > 1)
    got = events.compound_events(series(spark, flags), ["key"], delta, tau).collect()
    assert sorted((r.start_idx, r.end_idx, r.n_extreme_cases) for r in got) == want


def test_annual_grid(spark):
    df = spark.createDataFrame([("a", 2000, 3, 2), ("b", 2002, 5, 4)], "ensemble string, year int, length int, n_extreme_cases int")
    got = {(r.ensemble, r.year): r for r in stats.annual_stats(df, ["ensemble"], stats.year_range(spark, 2000, 2002)).collect()}
    assert len(got) == 6 and got["a", 2001].n_events == 0 and got["a", 2001].mean_length is None and got["b", 2002].total_duration == 4


def test_streaming_sessions_match_batch(spark, tmp_path):
    from stormspan.streaming import sessions

    days = series(spark, EXAMPLE).where("event = 1").select("key", "block", F.date_add(F.to_date(F.lit("2000-01-01")), F.col("idx")).cast("timestamp").alias("ts"))
    days.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(days.schema).parquet(str(tmp_path / "in"))
    q = sessions.compound_events(stream, ["key"]).writeStream.outputMode("complete").format("memory").queryName("sessions_test").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.length, r.n_extreme_cases) for r in spark.table("sessions_test").collect()] == [(7, 4)]


def test_sources(spark, tmp_path):
    text = "paths:\n  data: /x\n  list:\n    - 19800101\n    - '0000'\nthr: 20.5\nnames: [a, b]\n"
    assert io.plain_yaml(text) == {"paths": {"data": "/x", "list": [19800101, "0000"]}, "thr": 20.5, "names": ["a", "b"]}
    assert io.files_of_years(["a_19800101-19891230.nc", "b_1990-1999.nc", "c.nc"], 1985, 1987) == ["a_19800101-19891230.nc", "c.nc"]
    dates = io.date_selection(spark, {"0000": ["1980-06-25", "19800625"], "zz": ["19810101"]}, [], {"0000": "m0"})
    assert [tuple(r) for r in dates.collect()] == [("m0", "19800625")]
    df = spark.createDataFrame([("0000", "r", "v", 0, "20000101", 2000, 1, 1.0), ("0001", "r", "v", 0, "20000701", 2000, 7, 2.0)], io.SERIES)
    io.write_series(df, str(tmp_path / "s"))
    read = io.read_series(spark, str(tmp_path / "s"), season=(6, 4))
    assert [(r.ensemble, r.month) for r in read.collect()] == [("0001", 7)]
    assert [r.ensemble for r in io.missing_members(read, ["0000", "0001"]).collect()] == ["0000"]


def test_batch_from_the_command_line(spark, tmp_path):
    """Members by prefix, a season of two months, surrogates with a seed; four outputs."""
    rng = np.random.default_rng(3)
    rows = [(f"p{e}", r, "rain", i, f"{2000 + i // 360}{i % 360 // 30 + 1:02d}{i % 30 + 1:02d}", 2000 + i // 360, i % 360 // 30 + 1, float(rng.gamma(2, 6))) for e in ("01", "02", "03") for r in ("north", "south") for i in range(1080)]
    io.write_series(spark.createDataFrame(rows, io.SERIES), str(tmp_path / "in"))
    arguments = ["--series", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--ensembles", "01", "02", "--ensemble-prefix", "p", "--thresholds", "20", "25", "--delT", "1", "2", "--season", "7", "8", "--sigtest", "shuffle.surrogate", "--shuffle-reps", "20", "--seed", "5"]
    sweep.main(arguments)
    out = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / "summary")).collect()
    assert len(out) == 2 * 2 * 2 * 2 and {r.sigtest for r in out} == {"shuffle.surrogate"} and {r.n_jjas_days for r in out} == {180}
    again = sweep.run(spark.createDataFrame([(r[0][1:], *r[1:]) for r in rows if r[0] != "p03"], io.SERIES), sweep.configured(sweep.arguments().parse_args(arguments)))
    want = {(r.ensemble, r.region, r.wet_threshold, r.delT): (r.n_events, r.pvalue_precursor) for r in again["summary"].collect()}
    assert {(f"{int(r.ensemble):02d}", r.region, float(r.wet_threshold), r.delT): (r.n_events, r.pvalue_precursor) for r in out} == want
    for name, columns in (("regional_episodes", {"ensemble", "region", "event_type"}), ("national_episodes", {"regions", "rain_days"}), ("events_by_day", {"day_class", "yyyymmdd", "ensemble", "delT"})):
        table = spark.read.option("header", True).csv(str(tmp_path / "out" / name))
        assert columns <= set(table.columns) and table.count() == again[name].count() > 0


def test_compound_days_and_episodes_from_one_pass(spark):
    """The batch summary's counts are those of the operators that find members and events, for tau of one and beyond."""
    rng = np.random.default_rng(4)
    rows = [("a", r, "rain", i, f"{2000 + i // 360}{i % 360 // 30 + 1:02d}{i % 30 + 1:02d}", 2000 + i // 360, i % 360 // 30 + 1, float(rng.random())) for r in ("n", "s") for i in range(720)]
    series = spark.createDataFrame(rows, io.SERIES)
    for tau in (1, 2):
        config = sweep.SweepConfig(thresholds=(0.8,), deltas=(0, 3), tau=tau)
        marked = sweep.flagged(series, config)
        got = {(r.region, r.delT): (r.n_compound_days, r.n_compound_episodes, r.k_precursor, r.k_trigger) for r in sweep.summary(marked, config).collect()}
        for delta in config.deltas:
            days = {r.region: r["count"] for r in events.membership(marked, sweep.KEYS, delta, tau).groupBy("region").count().collect()}
            found = {r.region: r["count"] for r in events.compound_events(marked, sweep.KEYS, delta, tau).groupBy("region").count().collect()}
            both = {r.region: r for r in coincidence.analyse(marked.withColumns({"a": marked.event, "b": marked.event}), sweep.KEYS, delta, tau).collect()}
            for region in ("n", "s"):
                assert got[region, delta] == (days.get(region, 0), found.get(region, 0), both[region].k_prec, both[region].k_trigg)


def test_several_variables_must_be_named(spark, tmp_path):
    fields = spark.createDataFrame([("m", "20000101", 0.0, 0.0, 1.0, "t"), ("m", "20000101", 0.0, 0.0, 2.0, "u")], "member string, yyyymmdd string, lat double, lon double, value double, variable string")
    io.write_fields(fields, str(tmp_path / "f"))
    with pytest.raises(ValueError, match="several variables"):
        io.read_fields(spark, [str(tmp_path / "f")])
    assert [r.value for r in io.read_fields(spark, [str(tmp_path / "f")], variable="u").collect()] == [2.0]
