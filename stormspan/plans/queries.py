"""One query for each operator, over the shared tables, and the SQL that gives the same rows.

Orders stand for daily observations: order priorities are members, regions of the customers are regions, and a day's
value is its largest order. Days without an order are missing values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormspan.functions import calendar as cal
from stormspan.operators import coincidence, events, fields, flagging, stats, windows
from stormspan.plans import sweep

ER, R = ["ensemble", "region"], ["region"]
THRESHOLD, HIGH, SUM_HIGH = 300_000.0, 400_000.0, 600_000.0
PERIODS = ("1995-1997", "1997-1999", "1999-2001")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with member, region, cell and day. The dimension tables' sizes are known to the optimiser, which broadcasts what is small."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select("o_custkey", "o_totalprice", F.col("o_orderpriority").alias("ensemble"), F.to_date("o_orderdate").alias("day"))
    customer = read("customer").select("c_custkey", "c_nationkey")
    nation = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = _orders(spark, sf_dir).groupBy(*ER, "day").agg(F.max("o_totalprice").alias("value"))
    return cal.dense_axis(sparse, ER, "day", "value")


def daily(spark: SparkSession, sf_dir: str, agg: Callable[[str], Column] = F.max) -> DataFrame:
    sparse = _orders(spark, sf_dir).groupBy(*R, "day").agg(agg("o_totalprice").alias("value"))
    return cal.dense_axis(sparse, R, "day", "value")


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _orders(spark, sf_dir).groupBy(F.col("ensemble").alias("member"), cal.date_label(F.col("day")).alias("yyyymmdd"), F.floor(F.col("c_nationkey") / 5).cast("double").alias("lat"), (F.col("c_nationkey") % 5).cast("double").alias("lon"))
    return cells.agg(F.avg("o_totalprice").alias("value"))


def summer(series: DataFrame) -> DataFrame:
    return series.withColumn("block", cal.calendar_block(F.col("year"), F.col("month")))


def wet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member series with flags within summer blocks."""
    return flagging.flag_extremes(summer(members(spark, sf_dir)), ER, THRESHOLD)


def wet_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagging.flag_extremes(summer(daily(spark, sf_dir)), R, HIGH)


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.paired(wet_region(spark, sf_dir), flagging.flag_extremes(summer(daily(spark, sf_dir, F.sum)), R, SUM_HIGH), R)


def pair_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(spark, sf_dir).select("region", "block", "idx", F.col("e1").alias("a"), F.col("e2").alias("b"))


def self_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wet(spark, sf_dir).withColumns({"a": F.col("event"), "b": F.col("event")})


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound events of the member series with year."""
    return events.compound_events(wet(spark, sf_dir), ER, 4, 1).withColumn("year", F.col("block"))


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# --- SQL pieces -------------------------------------------------------------------------------------------------------

ORDERS = "o AS (SELECT o_orderpriority AS ensemble, r_name AS region, c_nationkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
AXIS = "ax AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM o), (SELECT max(d) FROM o), INTERVAL 1 DAY)) AS DATE) AS d)"


def _dense(name: str, keys: str, agg: str) -> str:
    on = " AND ".join(f"s.{k} = g.{k}" for k in keys.split(", "))
    return f"{name} AS (SELECT {', '.join(f'g.{k}' for k in keys.split(', '))}, CAST(date_diff('day', (SELECT min(d) FROM ax), ax.d) AS INT) AS idx, strftime(ax.d, '%Y%m%d') AS yyyymmdd, CAST(year(ax.d) AS INT) AS year, CAST(month(ax.d) AS INT) AS month, s.value FROM (SELECT DISTINCT {keys} FROM o) g CROSS JOIN ax LEFT JOIN (SELECT {keys}, d, {agg}(o_totalprice) AS value FROM o GROUP BY ALL) s ON {on} AND s.d = ax.d)"


MEMBERS, DAILY, DAILY2 = _dense("members", "ensemble, region", "max"), _dense("daily", "region", "max"), _dense("daily2", "region", "sum")


def _flag(name: str, table: str, test: str) -> str:
    return f"{name} AS (SELECT *, CASE WHEN month IN (6, 7, 8, 9) THEN year END AS block, CAST(coalesce({test}, false) AS INT) AS event FROM {table})"


WET = _flag("wet", "members", f"value > {THRESHOLD}")
WET_R = _flag("wetr", "daily", f"value > {HIGH}")
WET_2 = _flag("wet2", "daily2", f"value > {SUM_HIGH}")
PAIR = "pair AS (SELECT region, idx, x.block, x.event AS e1, y.event AS e2 FROM wetr x JOIN wet2 y USING (region, idx))"
SELF = "ab AS (SELECT ensemble, region, block, idx, yyyymmdd, event, event AS a, event AS b FROM wet WHERE block IS NOT NULL)"
PAIR_AB = "ab AS (SELECT region, block, idx, e1 AS a, e2 AS b FROM pair WHERE block IS NOT NULL)"
FIELD = "f AS (SELECT ensemble AS member, strftime(d, '%Y%m%d') AS yyyymmdd, CAST(c_nationkey // 5 AS DOUBLE) AS lat, CAST(c_nationkey % 5 AS DOUBLE) AS lon, avg(o_totalprice) AS value FROM o GROUP BY ALL)"


def _sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def _frame(lo: int, hi: int) -> str:
    end = lambda k: f"{-k} PRECEDING" if k < 0 else "CURRENT ROW" if k == 0 else f"{k} FOLLOWING"
    return f"RANGE BETWEEN {end(lo)} AND {end(hi)}"


def _marks(keys: str, delta: int, tau: int, sym: bool = False, out: str = "m") -> str:
    more, w = delta if sym else 0, f"PARTITION BY {keys}, block ORDER BY idx"
    return f"{out} AS (SELECT *, CAST(a = 1 AND coalesce(max(b) OVER ({w} {_frame(-tau - delta, -tau + more)}), 0) = 1 AS INT) AS prec, CAST(b = 1 AND coalesce(max(a) OVER ({w} {_frame(tau - more, tau + delta)}), 0) = 1 AS INT) AS trigg FROM ab)"


def _counts(keys: str) -> str:
    return f"bc AS (SELECT {keys}, block, count(*) AS t_len, sum(a) AS n_a, sum(b) AS n_b, sum(prec) AS k_prec, sum(trigg) AS k_trigg FROM m GROUP BY ALL), tot AS (SELECT {keys}, CAST(sum(t_len) AS BIGINT) AS t_len, CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_b) AS BIGINT) AS n_b, CAST(sum(k_prec) AS BIGINT) AS k_prec, CAST(sum(k_trigg) AS BIGINT) AS k_trigg FROM bc GROUP BY ALL)"


def _p(n: str, delta: int, tau: int, sym: bool = False) -> str:
    share = f"({2 * delta + 1}.0 / t_len)" if sym else f"({delta + 1}.0 / (t_len - {tau}))"
    return f"(1 - pow(CAST(1 - {share} AS DOUBLE), {n}))"


def _tail(n: str, p: str, k: str) -> str:
    return f"CASE WHEN {n} = 0 THEN NULL WHEN {k} <= 0 THEN 1.0 ELSE list_sum(list_transform(generate_series(CAST({k} AS BIGINT), CAST({n} AS BIGINT)), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))) END"


def _pmf(name: str, source: str, keys: str, n: str, p: str) -> str:
    """Distribution of the sum of Bernoulli trials, n of probability p for each row."""
    step = "lambda f, x: list_transform(generate_series(1, len(f) + 1), lambda i: coalesce(f[i], 0) * (1 - x[1]) + (CASE WHEN i > 1 THEN f[i - 1] ELSE 0 END) * x[1])"
    return f"{name} AS (SELECT {keys}, list_reduce(list_prepend([CAST(1 AS DOUBLE)], coalesce(list(t) FILTER (WHERE t IS NOT NULL), [])), {step}) AS pmf FROM (SELECT {keys}, CASE WHEN {n} > 0 THEN [CAST({p} AS DOUBLE)] END AS t, unnest(generate_series(1, greatest(CAST({n} AS BIGINT), 1))) FROM {source}) GROUP BY ALL)"


def _quantile(q: float) -> str:
    first = f"list_position(list_transform(cdf, lambda x: x >= {q}), true)"
    return f"CASE WHEN {first} = 1 THEN 0.0 ELSE {first} - 2 + ({q} - cdf[{first} - 1]) / (cdf[{first}] - cdf[{first} - 1]) END"


CDF = "list_transform(generate_series(1, len(pmf)), lambda n: list_sum(pmf[1:n]) / list_sum(pmf)) AS cdf"


def _sessions(name: str, source: str, keys: str, gap: int, where: str = "event = 1 AND block IS NOT NULL") -> str:
    w = f"PARTITION BY {keys}, block ORDER BY idx"
    return f"{name} AS (SELECT *, sum(nw) OVER ({w}) AS session FROM (SELECT *, CASE WHEN idx - lag(idx) OVER ({w}) <= {gap} THEN 0 ELSE 1 END AS nw FROM {source} WHERE {where}))"


def _events(name: str, source: str, keys: str, least: int = 2) -> str:
    return f"{name} AS (SELECT {keys}, block, min(idx) AS start_idx, max(idx) AS end_idx, max(idx) - min(idx) + 1 AS length, count(*) AS n_extreme_cases FROM {source} GROUP BY {keys}, block, session HAVING count(*) >= {least})"


BASE = (ORDERS, AXIS, MEMBERS, WET)
BASE_R = (ORDERS, AXIS, DAILY, WET_R)
BASE_P = (ORDERS, AXIS, DAILY, DAILY2, WET_R, WET_2, PAIR)
FOUND = (*BASE, _sessions("s", "wet", "ensemble, region", 5), _events("ev0", "s", "ensemble, region"), "ev AS (SELECT *, block AS year FROM ev0)")

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- flags ------------------------------------------------------------------------------------------------------------


@query(_sql(*BASE, "SELECT ensemble, region, idx, yyyymmdd FROM wet WHERE event = 1"))
def flag_fixed(spark, d):
    return flagging.flag_extremes(members(spark, d), ER, THRESHOLD).where("event = 1").select(*ER, "idx", "yyyymmdd")


@query(_sql(ORDERS, AXIS, MEMBERS, "SELECT ensemble, region, idx FROM members WHERE value < 50000"))
def flag_below(spark, d):
    return flagging.flag_extremes(members(spark, d), ER, 50_000.0, direction="below").where("event = 1").select(*ER, "idx")


def _greedy(n: int, least: int, threshold: float = 250_000.0) -> tuple[str, ...]:
    ex = f"x AS MATERIALIZED (SELECT *, CAST(coalesce(value > {threshold}, false) AS INT) AS ex FROM daily)"
    fits = f"fit AS MATERIALIZED (SELECT region, idx FROM (SELECT region, idx, sum(ex) OVER w AS c, count(*) OVER w AS k FROM x WINDOW w AS (PARTITION BY region ORDER BY idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE k = {n} AND c >= {least})"
    nxt = f"nxt AS MATERIALIZED (SELECT a.region, a.idx, min(b.idx) AS n FROM fit a LEFT JOIN fit b ON a.region = b.region AND b.idx >= a.idx + {n} GROUP BY ALL)"
    hit = "hit AS (SELECT region, min(idx) AS idx FROM fit GROUP BY region UNION ALL SELECT nxt.region, nxt.n FROM hit JOIN nxt USING (region, idx) WHERE nxt.n IS NOT NULL)"
    marks = f"mk AS (SELECT x.region, x.idx, x.value, x.ex, CAST(x.idx = h.idx AS INT) AS f, CAST(x.idx = h.idx + {n - 1} AS INT) AS l, CAST(h.idx IS NOT NULL AND x.ex = 1 AS INT) AS e FROM x LEFT JOIN hit h ON h.region = x.region AND x.idx BETWEEN h.idx AND h.idx + {n - 1})"
    return (ORDERS, AXIS, DAILY, ex, fits, nxt, hit, marks)


def _spell(spark, d, flag):
    return flagging.flag_extremes(daily(spark, d), R, 250_000.0, n=3, flag=flag).where("event = 1").select("region", "idx")


@query(_sql(*_greedy(3, 3), "SELECT region, idx FROM mk WHERE l = 1"))
def flag_spell_last(spark, d):
    return _spell(spark, d, "last")


@query(_sql(*_greedy(3, 3), "SELECT region, idx FROM mk WHERE f = 1"))
def flag_spell_first(spark, d):
    return _spell(spark, d, "first")


@query(_sql(*_greedy(3, 3), "SELECT region, idx FROM mk WHERE e = 1"))
def flag_spell_all(spark, d):
    return _spell(spark, d, "all")


@query(_sql(*_greedy(5, 3), "SELECT region, idx FROM mk WHERE l = 1"))
def flag_min_days(spark, d):
    return flagging.flag_extremes(daily(spark, d), R, 250_000.0, n=5, min_days=3).where("event = 1").select("region", "idx")


@query(_sql(*_greedy(4, 2), "SELECT region, idx, coalesce(f, 0) AS event_first, coalesce(e, 0) AS event_all, coalesce(l, 0) AS event_last FROM mk"))
def flag_combined(spark, d):
    return flagging.flag_extremes(daily(spark, d), R, 250_000.0, n=4, min_days=2, flag="combined").select("region", "idx", "event_first", "event_all", "event_last")


@query(_sql(ORDERS, AXIS, DAILY, "SELECT region, idx, round(threshold, 6) AS threshold FROM daily JOIN (SELECT region, quantile_cont(value, 0.95) AS threshold FROM daily GROUP BY region) USING (region) WHERE value > threshold"))
def flag_percentile(spark, d):
    return rounded(flagging.flag_percentile(daily(spark, d), R, 95.0).where("event = 1").select("region", "idx", "threshold"), threshold=6)


@query(_sql(*_greedy(3, 2), "SELECT region, idx, round(value, 6) AS value, ex AS extreme, coalesce(l, 0) AS last, coalesce(f, 0) AS first, coalesce(e, 0) AS \"all\" FROM mk JOIN (SELECT region, greatest(min(idx) FILTER (WHERE f = 1 OR l = 1 OR e = 1) - 10, 0) AS lo FROM mk GROUP BY region) USING (region) WHERE idx >= lo AND idx < lo + 40"))
def compare_flag_options(spark, d):
    return rounded(flagging.compare_flags(daily(spark, d), R, 250_000.0, 3, 2, show=40), value=6)


# --- seasons ----------------------------------------------------------------------------------------------------------


def _block_sizes(series: DataFrame) -> DataFrame:
    return series.where("block IS NOT NULL").groupBy("region", "block").agg(F.count("*").alias("n_days"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query(_sql(ORDERS, AXIS, DAILY, "SELECT region, year AS block, count(*) AS n_days, CAST(min(idx) AS INT) AS first_idx, CAST(max(idx) AS INT) AS last_idx FROM daily WHERE month IN (6, 7, 8, 9) GROUP BY ALL"))
def season_blocks_jjas(spark, d):
    return _block_sizes(summer(daily(spark, d)))


@query(_sql(ORDERS, AXIS, DAILY, "SELECT region, CASE WHEN month >= 10 THEN year ELSE year - 1 END AS block, count(*) AS n_days, CAST(min(idx) AS INT) AS first_idx, CAST(max(idx) AS INT) AS last_idx FROM daily WHERE month IN (10, 11, 12, 1, 2) GROUP BY ALL"))
def season_blocks_wrapped(spark, d):
    return _block_sizes(cal.with_blocks(daily(spark, d), 10, 5))


@query(_sql(ORDERS, AXIS, DAILY, "SELECT region, CAST(year - (SELECT min(year) FROM daily) AS INT) AS block, count(*) AS n_days, CAST(min(idx) AS INT) AS first_idx, CAST(max(idx) AS INT) AS last_idx FROM daily GROUP BY region, year"))
def season_blocks_runs(spark, d):
    return _block_sizes(cal.run_blocks(daily(spark, d), R, "year"))


@query("SELECT o_orderkey, printf('%04d%02d%02d', CAST(floor(t / 360) AS INT), CAST(t % 360 // 30 + 1 AS INT), CAST(t % 30 + 1 AS INT)) AS label FROM (SELECT o_orderkey, year(o_orderdate) * 360 + (month(o_orderdate) - 1) * 30 + (day(o_orderdate) - 1) - 45 AS t FROM orders)")
def shift_360(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", cal.shift_360(cal.date_label(F.col("o_orderdate")), -45).alias("label"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS label, strftime(o_orderdate, '%m%d') AS mmdd FROM orders")
def normal_labels(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    label = cal.normal_label(F.date_format("o_orderdate", "yyyy/MM-dd"))
    return orders.select(label.alias("label")).distinct().select("label", cal.month_day(F.col("label")).alias("mmdd"))


# --- coincidence ------------------------------------------------------------------------------------------------------


@query(_sql(*BASE_P, PAIR_AB, _marks("region", 4, 1), "SELECT region, idx FROM m WHERE prec = 1"))
def eca_precursor(spark, d):
    return coincidence.marks(pair_ab(spark, d), R, 4, 1).where("prec = 1").select("region", "idx")


@query(_sql(*BASE_P, PAIR_AB, _marks("region", 4, 1), "SELECT region, idx FROM m WHERE trigg = 1"))
def eca_trigger(spark, d):
    return coincidence.marks(pair_ab(spark, d), R, 4, 1).where("trigg = 1").select("region", "idx")


RATES = "t_len, n_a, n_b, k_prec, k_trigg, round(k_prec / nullif(n_a, 0), 9) AS rate_prec, round(k_trigg / nullif(n_b, 0), 9) AS rate_trigg"


def _rates(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return rounded(df.select(*keys, "t_len", "n_a", "n_b", "k_prec", "k_trigg", "rate_prec", "rate_trigg", *more), rate_prec=9, rate_trigg=9, **dict.fromkeys(more, 9))


@query(_sql(*BASE, SELF, _marks("ensemble, region", 4, 1), _counts("ensemble, region"), f"SELECT ensemble, region, {RATES} FROM tot"))
def eca_self_summary(spark, d):
    return _rates(coincidence.analyse(self_ab(spark, d), ER, 4, 1, null_model=None), ER)


@query(_sql(*BASE_P, PAIR_AB, _marks("region", 4, 1), _counts("region"), f"SELECT region, {RATES} FROM tot"))
def eca_bivariate(spark, d):
    return _rates(coincidence.analyse(pair_ab(spark, d), R, 4, 1, null_model=None), R)


@query(_sql(*BASE_P, PAIR_AB, _marks("region", 2, 0, True), _counts("region"), f"SELECT region, {RATES}, round({_tail('n_a', _p('n_b', 2, 0, True), 'k_prec')}, 9) AS pvalue_prec, round({_tail('n_b', _p('n_a', 2, 0, True), 'k_trigg')}, 9) AS pvalue_trigg FROM tot"))
def eca_sym(spark, d):
    return _rates(coincidence.analyse(pair_ab(spark, d), R, 2, 0, True), R, "pvalue_prec", "pvalue_trigg")


@query(_sql(*BASE, SELF, _marks("ensemble, region", 1, 1), _counts("ensemble, region"), f"SELECT ensemble, region, {RATES}, round({_tail('n_a', _p('n_b', 1, 1), 'k_prec')}, 9) AS pvalue_prec, round({_tail('n_b', _p('n_a', 1, 1), 'k_trigg')}, 9) AS pvalue_trigg FROM tot"))
def eca_pvalue_pooled(spark, d):
    return _rates(coincidence.analyse(self_ab(spark, d), ER, 1, 1), ER, "pvalue_prec", "pvalue_trigg")


def _upper(pmf: str, k: str) -> str:
    return f"CASE WHEN len({pmf}) > 1 THEN coalesce(list_sum({pmf}[CAST({k} AS BIGINT) + 1:]), 0) / list_sum({pmf}) END"


@query(_sql(*BASE, SELF, _marks("ensemble, region", 1, 1), _counts("ensemble, region"), _pmf("pp", "bc", "ensemble, region", "n_a", _p("n_b", 1, 1)), _pmf("pt", "bc", "ensemble, region", "n_b", _p("n_a", 1, 1)), f"SELECT ensemble, region, round({_upper('pp.pmf', 'k_prec')}, 9) AS pvalue_prec, round({_upper('pt.pmf', 'k_trigg')}, 9) AS pvalue_trigg FROM tot JOIN pp USING (ensemble, region) JOIN pt USING (ensemble, region)"))
def eca_pvalue_blocked(spark, d):
    return rounded(coincidence.analyse(self_ab(spark, d), ER, 1, 1, null_model="blocked").select(*ER, "pvalue_prec", "pvalue_trigg"), pvalue_prec=9, pvalue_trigg=9)


@query(_sql(*BASE, SELF, _marks("ensemble, region", 1, 1), _counts("ensemble, region"), f"SELECT ensemble, region, coalesce({_tail('n_a', _p('n_b', 1, 1), 'k_prec')} >= 0.05, false) AS null_prec, coalesce({_tail('n_b', _p('n_a', 1, 1), 'k_trigg')} >= 0.05, false) AS null_trigg FROM tot"))
def eca_null_hypothesis(spark, d):
    return coincidence.analyse(self_ab(spark, d), ER, 1, 1, alpha=0.05).select(*ER, "null_prec", "null_trigg")


@query(_sql(*BASE, SELF, _marks("ensemble, region", 4, 1), _counts("ensemble, region"), "SELECT ensemble, region, quantity, round(value, 9) AS value FROM (SELECT ensemble, region, unnest(['N events A', 'N events B', 'K precursor', 'K trigger', 'precursor rate', 'trigger rate']) AS quantity, unnest([CAST(n_a AS DOUBLE), n_b, k_prec, k_trigg, k_prec / nullif(n_a, 0), k_trigg / nullif(n_b, 0)]) AS value FROM tot)"))
def eca_summary_table(spark, d):
    out = coincidence.summary_table(coincidence.analyse(self_ab(spark, d), ER, 4, 1), ER)
    return rounded(out.where(~F.col("quantity").startswith("p-value")), value=9)


def _band_sql(source: str, p: str) -> str:
    return _sql(*BASE, SELF, _marks("ensemble, region", 1, 1), _counts("ensemble, region"), _pmf("pt", source, "ensemble, region", "n_b", p), f"c AS (SELECT ensemble, region, {CDF} FROM pt)", f"SELECT ensemble, region, k_trigg, round({_quantile(0.025)}, 6) AS band_lo, round({_quantile(0.975)}, 6) AS band_hi, CAST(k_trigg > {_quantile(0.975)} AS INT) AS significant FROM tot JOIN c USING (ensemble, region)")


@query(_band_sql("tot", _p("n_a", 1, 1)))
def eca_null_band_pooled(spark, d):
    return rounded(coincidence.null_band(self_ab(spark, d), ER, 1, 1), band_lo=6, band_hi=6)


@query(_band_sql("bc", _p("n_a", 1, 1)))
def eca_null_band_blocked(spark, d):
    return rounded(coincidence.null_band(self_ab(spark, d), ER, 1, 1, null_model="blocked"), band_lo=6, band_hi=6)


# --- compound events --------------------------------------------------------------------------------------------------


@query(_sql(*BASE, SELF, _marks("ensemble, region", 4, 1), "SELECT ensemble, region, idx, yyyymmdd FROM m WHERE prec = 1 OR trigg = 1"))
def compound_membership(spark, d):
    return events.membership(wet(spark, d), ER, 4, 1).select(*ER, "idx", "yyyymmdd")


EVENT_COLS = "CAST(start_idx AS INT) AS start_idx, CAST(end_idx AS INT) AS end_idx, CAST(length AS INT) AS length"


@query(_sql(*FOUND, f"SELECT ensemble, region, block, {EVENT_COLS}, n_extreme_cases FROM ev"))
def compound_events_single(spark, d):
    return events.compound_events(wet(spark, d), ER, 4, 1)


@query(_sql(*BASE_P, _sessions("s", "pair", "region", 3, "block IS NOT NULL AND (e1 = 1 OR e2 = 1)"), f"SELECT region, block, {EVENT_COLS}, CAST(n1 + n2 AS BIGINT) AS n_extreme_cases, CAST(n1 AS BIGINT) AS n_extreme_cases_1, CAST(n2 AS BIGINT) AS n_extreme_cases_2 FROM (SELECT region, block, min(idx) AS start_idx, max(idx) AS end_idx, max(idx) - min(idx) + 1 AS length, sum(e1) AS n1, sum(e2) AS n2 FROM s GROUP BY region, block, session) WHERE n1 >= 1 AND n2 >= 1"))
def compound_events_sequential(spark, d):
    return events.sequential_events(pair(spark, d), R, 2, 1)


@query(_sql(*BASE_P, _sessions("s", "pair", "region", 5, "block IS NOT NULL AND e1 = 1 AND e2 = 1"), "g AS (SELECT region, block, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n FROM s GROUP BY region, block, session)", "SELECT g.region, g.block, CAST(start_idx AS INT) AS start_idx, CAST(end_idx AS INT) AS end_idx, CAST(end_idx - start_idx + 1 AS INT) AS length, n AS n_extreme_cases, CAST(sum(e1) AS BIGINT) AS n_extreme_cases_1, CAST(sum(e2) AS BIGINT) AS n_extreme_cases_2, n AS n_coincident_cases FROM g JOIN pair p ON p.region = g.region AND p.idx BETWEEN start_idx AND end_idx GROUP BY ALL"))
def compound_events_cooccurring(spark, d):
    return events.cooccurring_events(pair(spark, d), R, 4, 1)


@query(_sql(*BASE, "v AS (SELECT ensemble, region, block, idx FROM wet WHERE event = 1 AND block IS NOT NULL)", "e AS (SELECT ensemble, region, block, a.idx AS x, b.idx AS y FROM v a JOIN v b USING (ensemble, region, block) WHERE abs(a.idx - b.idx) BETWEEN 2 AND 5)", "r AS (SELECT ensemble, region, block, idx, idx AS lab FROM v UNION SELECT e.ensemble, e.region, e.block, e.y, r.lab FROM r JOIN e ON r.ensemble = e.ensemble AND r.region = e.region AND r.block = e.block AND r.idx = e.x WHERE r.lab < e.y)", "l AS (SELECT ensemble, region, block, idx, min(lab) AS session FROM r GROUP BY ALL)", _events("g", "l", "ensemble, region"), f"SELECT ensemble, region, block, {EVENT_COLS}, n_extreme_cases FROM g"))
def compound_components_tau2(spark, d):
    return events.compound_events(wet(spark, d), ER, 3, 2)


EPISODE = "CASE WHEN count(*) >= 2 THEN 'compound' ELSE 'single' END AS event_type, CAST(min(idx) AS INT) AS start_index, CAST(max(idx) AS INT) AS end_index, min(yyyymmdd) AS start_yyyymmdd, max(yyyymmdd) AS end_yyyymmdd, count(*) AS duration, CAST(max(idx) - min(idx) + 1 AS INT) AS length, string_agg(yyyymmdd, ';' ORDER BY idx) AS rain_days"


@query(_sql(*BASE, _sessions("s", "wet", "ensemble, region", 5), f"SELECT ensemble, region, block AS year, {EPISODE} FROM s GROUP BY ensemble, region, block, session"))
def episode_stats(spark, d):
    return events.episodes(wet(spark, d), ER, 4, 1)


NATIONAL = "nat AS (SELECT *, row_number() OVER (PARTITION BY ensemble ORDER BY yyyymmdd) - 1 AS idx, CAST(substr(yyyymmdd, 1, 4) AS INT) AS block FROM (SELECT ensemble, yyyymmdd, max(event) AS event, list(region) FILTER (WHERE event = 1) AS regions FROM wet WHERE block IS NOT NULL GROUP BY ALL))"


@query(_sql(*BASE, NATIONAL, _sessions("s", "nat", "ensemble", 2), f"SELECT ensemble, block AS year, {EPISODE}, array_to_string(list_sort(list_distinct(flatten(list(regions)))), ';') AS regions FROM s GROUP BY ensemble, block, session"))
def episode_stats_national(spark, d):
    return events.national_episodes(wet(spark, d), ["ensemble"], 1, 1)


@query(_sql(*BASE, SELF, _marks("ensemble, region", 2, 1), "SELECT ensemble, CASE WHEN max(greatest(prec, trigg)) = 1 THEN 'compound' WHEN max(event) = 1 THEN 'single' ELSE 'no events' END AS day_class, yyyymmdd FROM m GROUP BY ensemble, yyyymmdd"))
def classify_days(spark, d):
    return events.classify_days(wet(spark, d), ER, ["ensemble"], 2, 1)


@query(_sql(*BASE_R, "runs AS (SELECT *, idx - row_number() OVER (PARTITION BY region, block ORDER BY idx) AS run FROM wetr WHERE event = 1 AND block IS NOT NULL)", "SELECT region, block, CAST(min(idx) AS INT) AS start_idx, CAST(max(idx) AS INT) AS end_idx, count(*) AS length FROM runs GROUP BY region, block, run"))
def maximal_spells(spark, d):
    return events.spells(wet_region(spark, d), R)


THIN = ("v AS (SELECT region, block, idx FROM wetr WHERE event = 1 AND block IS NOT NULL)", "nxt AS MATERIALIZED (SELECT a.region, a.block, a.idx, min(b.idx) AS n FROM v a LEFT JOIN v b ON a.region = b.region AND a.block = b.block AND b.idx > a.idx + 4 GROUP BY ALL)", "hit AS (SELECT region, block, min(idx) AS idx FROM v GROUP BY ALL UNION ALL SELECT nxt.region, nxt.block, nxt.n FROM hit JOIN nxt USING (region, block, idx) WHERE nxt.n IS NOT NULL)")


@query(_sql(*BASE_R, *THIN, "SELECT region, block, CAST(idx AS INT) AS idx FROM hit"))
def legacy_dedup(spark, d):
    return events.thinned(wet_region(spark, d), R, 4)


@query(_sql(*BASE_R, *THIN, "SELECT DISTINCT v.region, v.block, CAST(v.idx AS INT) AS idx FROM v JOIN hit ON v.region = hit.region AND v.block = hit.block AND v.idx BETWEEN hit.idx AND hit.idx + 2"))
def legacy_expand(spark, d):
    flags = wet_region(spark, d)
    return events.expanded(events.thinned(flags, R, 4), flags, R, 2)


@query(_sql(*FOUND, "days AS (SELECT DISTINCT ensemble, block, idx, 1 AS event FROM (SELECT ensemble, block, unnest(generate_series(start_idx, end_idx)) AS idx FROM ev))", _sessions("s2", "days", "ensemble", 5), _events("g", "s2", "ensemble"), f"SELECT ensemble, block, {EVENT_COLS}, n_extreme_cases FROM g"))
def uk_union_events(spark, d):
    flags = wet(spark, d)
    return events.union_events(events.compound_events(flags, ER, 4, 1), flags, ER, ["ensemble"], 4, 1)


# --- thresholds and windows -------------------------------------------------------------------------------------------


@query(_sql(ORDERS, AXIS, DAILY, "SELECT region, round(50.0 * (lo + hi + CASE WHEN hi > lo THEN 1 ELSE 0 END) / n, 9) AS rank FROM (SELECT region, count(*) FILTER (WHERE value < 400000) AS lo, count(*) FILTER (WHERE value <= 400000) AS hi, count(value) AS n FROM daily GROUP BY region)"))
def percentile_rank(spark, d):
    return rounded(flagging.percentile_rank(daily(spark, d), R, HIGH), rank=9)


PERIOD = "per AS (SELECT * FROM (VALUES ('1995-1997', 1995, 1997), ('1997-1999', 1997, 1999), ('1999-2001', 1999, 2001)) t(period, y0, y1))"
THERMO = (
    "days AS (SELECT s.*, period FROM daily s JOIN per ON year BETWEEN y0 AND y1 WHERE month IN (6, 7, 8, 9))",
    "base AS (SELECT region, 50.0 * (lo + hi + CASE WHEN hi > lo THEN 1 ELSE 0 END) / n AS base_rank FROM (SELECT region, count(*) FILTER (WHERE value < 400000) AS lo, count(*) FILTER (WHERE value <= 400000) AS hi, count(value) AS n FROM days WHERE period = '1995-1997' GROUP BY region))",
    "vals AS (SELECT region, period, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS v FROM days GROUP BY ALL)",
    "thr AS (SELECT region, period, base_rank, v[k + 1] + (v[least(k + 2, len(v))] - v[k + 1]) * (pos - k) AS threshold FROM (SELECT *, (len(v) - 1) * base_rank / 100 AS pos, CAST(floor((len(v) - 1) * base_rank / 100) AS BIGINT) AS k FROM vals JOIN base USING (region)))",
)


@query(_sql(ORDERS, AXIS, DAILY, PERIOD, *THERMO, "SELECT region, period, round(base_rank, 9) AS base_rank, round(threshold, 6) AS threshold FROM thr"))
def thermo_thresholds(spark, d):
    days = windows.in_periods(daily(spark, d).where(F.col("month").isin(6, 7, 8, 9)), PERIODS)
    return rounded(flagging.matched_thresholds(days, R, "period", PERIODS[0], HIGH), base_rank=9, threshold=6)


WINDOWED = (
    *THERMO,
    "reg AS (SELECT region, period, 'fixed' AS regime, CAST(400000 AS DOUBLE) AS threshold FROM thr UNION ALL SELECT region, period, 'thermodynamic', threshold FROM thr)",
    "ab AS (SELECT d.region, d.period, regime, year AS block, idx, CAST(coalesce(value > threshold, false) AS INT) AS a, CAST(coalesce(value > threshold, false) AS INT) AS b FROM days d JOIN reg USING (region, period))",
    _marks("region, period, regime", 2, 1),
    _counts("region, period, regime"),
    _pmf("pt", "tot", "region, period, regime", "n_b", _p("n_a", 2, 1)),
    f"c AS (SELECT region, period, regime, {CDF} FROM pt)",
    f"win AS (SELECT region, period, regime, threshold, k_trigg, {_quantile(0.025)} AS lo, {_quantile(0.975)} AS hi FROM tot JOIN c USING (region, period, regime) JOIN reg USING (region, period, regime))",
)
WINDOW_CONFIG = windows.WindowConfig(periods=PERIODS, baseline=PERIODS[0], fixed_threshold=HIGH, delta=2)


@query(_sql(ORDERS, AXIS, DAILY, PERIOD, *WINDOWED, "SELECT w.region, w.period, w.regime, round(w.threshold, 6) AS threshold, w.k_trigg AS k_trig, round(w.lo, 6) AS band_lo, round(w.hi, 6) AS band_hi, CAST(w.k_trigg > w.hi AS INT) AS significant, CASE WHEN w.regime = 'thermodynamic' THEN f.k_trigg END AS k_trig_fixed, CASE WHEN w.regime = 'thermodynamic' THEN w.k_trigg END AS k_trig_thermo FROM win w JOIN win f ON f.region = w.region AND f.period = w.period AND f.regime = 'fixed'"))
def window_analysis(spark, d):
    return rounded(windows.analyse_windows(daily(spark, d), R, WINDOW_CONFIG), threshold=6, band_lo=6, band_hi=6)


@query(_sql(ORDERS, AXIS, DAILY, PERIOD, *WINDOWED, "SELECT region AS \"Region\", CAST(sum(CASE WHEN period = '1995-1997' AND regime = 'fixed' AND k_trigg > hi THEN 1 ELSE 0 END) AS BIGINT) AS \"1995-1997 Fixed Threshold\", CAST(sum(CASE WHEN period = '1999-2001' AND regime = 'fixed' AND k_trigg > hi THEN 1 ELSE 0 END) AS BIGINT) AS \"1999-2001 Fixed Threshold\", CAST(sum(CASE WHEN period = '1999-2001' AND regime = 'thermodynamic' AND k_trigg > hi THEN 1 ELSE 0 END) AS BIGINT) AS \"1999-2001 Thermo Threshold\" FROM win GROUP BY region"))
def ensemble_agreement(spark, d):
    return stats.agreement(windows.analyse_windows(daily(spark, d), R, WINDOW_CONFIG), PERIODS[0], PERIODS[2])


@query(_sql(ORDERS, AXIS, DAILY, WET_R, PERIOD, "ab AS (SELECT region, period, block, idx, event AS a, event AS b FROM wetr JOIN per ON year BETWEEN y0 AND y1 WHERE block IS NOT NULL)", _marks("region, period", 4, 1), _counts("region, period"), f"SELECT region, period, {RATES}, round({_tail('n_a', _p('n_b', 4, 1), 'k_prec')}, 9) AS pvalue_prec FROM tot"))
def eca_rolling(spark, d):
    return _rates(windows.rolling_coincidence(wet_region(spark, d), R, PERIODS), [*R, "period"], "pvalue_prec")


# --- statistics -------------------------------------------------------------------------------------------------------


def _annual(keys: str, source: str, case: str = "n_extreme_cases") -> str:
    on = f"({keys}, year)"
    return f"SELECT {keys}, year, coalesce(n, 0) AS n_events, CAST(coalesce(td, 0) AS BIGINT) AS total_duration, round(md, 6) AS mean_duration, CAST(coalesce(xd, 0) AS BIGINT) AS max_duration, CAST(coalesce(tl, 0) AS BIGINT) AS total_length, round(ml, 6) AS mean_length, CAST(coalesce(xl, 0) AS BIGINT) AS max_length FROM (SELECT DISTINCT {keys} FROM {source}) CROSS JOIN (SELECT DISTINCT year FROM {source}) LEFT JOIN (SELECT {keys}, year, count(*) AS n, sum({case}) AS td, avg({case}) AS md, max({case}) AS xd, sum(length) AS tl, avg(length) AS ml, max(length) AS xl FROM {source} GROUP BY ALL) USING {on}"


@query(_sql(*FOUND, _annual("ensemble", "ev")))
def annual_stats(spark, d):
    return rounded(stats.annual_stats(found(spark, d), ["ensemble"]), mean_duration=6, mean_length=6)


@query(_sql(*FOUND, _sessions("s9", "wet", "ensemble, region", 2), _events("ev9", "s9", "ensemble, region"), "evb AS (SELECT *, block AS year FROM ev9)", f"a AS ({_annual('ensemble', 'ev')})", f"b AS ({_annual('ensemble', 'evb')})", "SELECT 'wide' AS variable, * FROM a UNION ALL SELECT 'narrow', * FROM b"))
def annual_stats_by_variable(spark, d):
    narrow = events.compound_events(wet(spark, d), ER, 1, 1).withColumn("year", F.col("block"))
    return rounded(stats.annual_stats_by_variable({"wide": found(spark, d), "narrow": narrow}, ["ensemble"]), mean_duration=6, mean_length=6)


@query(_sql(*BASE_R, "runs AS (SELECT *, idx - row_number() OVER (PARTITION BY region, block ORDER BY idx) AS run FROM wetr WHERE event = 1 AND block IS NOT NULL)", "sp AS (SELECT region, block AS year, count(*) AS length FROM runs GROUP BY region, block, run)", _annual("region", "sp", "length")))
def flag_annual_stats(spark, d):
    return rounded(stats.flag_annual_stats(wet_region(spark, d), R), mean_duration=6, mean_length=6)


@query(_sql(*FOUND, "SELECT ensemble, year, coalesce(n, 0) AS n_events, CAST(coalesce(td, 0) AS BIGINT) AS n_extreme_cases, CAST(coalesce(xd, 0) AS BIGINT) AS max_duration, round(md, 6) AS mean_duration, coalesce(du, '') AS durations, round(ml, 6) AS mean_length FROM (SELECT DISTINCT ensemble FROM ev) CROSS JOIN (SELECT DISTINCT year FROM ev) LEFT JOIN (SELECT ensemble, year, count(*) AS n, sum(n_extreme_cases) AS td, max(n_extreme_cases) AS xd, avg(n_extreme_cases) AS md, string_agg(CAST(n_extreme_cases AS VARCHAR), ',' ORDER BY start_idx, n_extreme_cases) AS du, avg(length) AS ml FROM ev GROUP BY ALL) USING (ensemble, year)"))
def hovmoller(spark, d):
    return rounded(stats.hovmoller(found(spark, d)), mean_duration=6, mean_length=6).withColumn("durations", F.array_join(F.col("durations").cast("array<string>"), ","))


MEMBER_GRID = "g AS (SELECT ensemble, year, coalesce(n, 0) AS n FROM (SELECT DISTINCT ensemble FROM ev) CROSS JOIN (SELECT DISTINCT year FROM ev) LEFT JOIN (SELECT ensemble, year, count(*) AS n FROM ev GROUP BY ALL) USING (ensemble, year))"


@query(_sql(*FOUND, MEMBER_GRID, "SELECT year, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, median(n) AS median, count(*) FILTER (WHERE n > 0) AS n_members FROM g GROUP BY year"))
def ensemble_summary(spark, d):
    return rounded(stats.ensemble_summary(found(spark, d)), mean=6)


@query(_sql(*FOUND, "g AS (SELECT ensemble, year, coalesce(n, 0) AS n FROM (SELECT DISTINCT ensemble FROM members) CROSS JOIN (SELECT unnest(generate_series(1995, 2001)) AS year) LEFT JOIN (SELECT ensemble, year, count(*) AS n FROM ev GROUP BY ALL) USING (ensemble, year))", "r AS (SELECT *, avg(n) OVER (PARTITION BY ensemble ORDER BY year ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m FROM g)", "SELECT CAST(year AS INT) AS year, round(avg(m), 6) AS mean_rolling, min(n) AS min, max(n) AS max FROM r GROUP BY year"))
def ensemble_spread_rolling(spark, d):
    return rounded(stats.spread(found(spark, d), members(spark, d), stats.year_range(spark, 1995, 2001), 4), mean_rolling=6)


@query(_sql(*FOUND, "g AS (SELECT ensemble, year, count(*) AS n FROM ev GROUP BY ALL)", "SELECT ensemble, year, n, CASE WHEN count(*) OVER w = 3 THEN round(avg(n) OVER w, 6) END AS rolling FROM g WINDOW w AS (PARTITION BY ensemble ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))
def event_timeseries_rolling(spark, d):
    return rounded(stats.rolling_mean(stats.annual_counts(found(spark, d), ["ensemble"]), ["ensemble"], 3, True), rolling=6)


@query(_sql(*FOUND, "SELECT duration, year, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, (SELECT max(n_extreme_cases) FROM ev))) AS duration) CROSS JOIN (SELECT DISTINCT year FROM ev) LEFT JOIN (SELECT n_extreme_cases AS duration, year, count(*) AS n FROM ev GROUP BY ALL) USING (duration, year)"))
def duration_matrix(spark, d):
    return stats.duration_matrix(found(spark, d))


@query(_sql(*FOUND, "SELECT region, year, round(coalesce(n, 0) / m, 6) AS mean_cases FROM (SELECT region, count(DISTINCT ensemble) AS m FROM ev GROUP BY region) CROSS JOIN (SELECT DISTINCT year FROM ev) LEFT JOIN (SELECT region, year, sum(n_extreme_cases) AS n FROM ev GROUP BY ALL) USING (region, year)"))
def regional_mean_matrix(spark, d):
    return rounded(stats.regional_means(found(spark, d)), mean_cases=6)


@query(_sql(*FOUND, "SELECT ensemble, count(*) AS total, CAST(row_number() OVER (ORDER BY count(*), ensemble) AS INT) AS place FROM ev GROUP BY ensemble"))
def member_order(spark, d):
    return stats.member_order(found(spark, d))


# --- the batch analysis -----------------------------------------------------------------------------------------------

SWEEP = sweep.SweepConfig(thresholds=(THRESHOLD, HIGH), deltas=(1, 4))


def _sweep_sql(delta: int, threshold: float) -> str:
    parts = (_flag("w", "members", f"value > {threshold}"), "ab AS (SELECT ensemble, region, block, idx, event, event AS a, event AS b FROM w WHERE block IS NOT NULL)", _marks("ensemble, region", delta, 1), _counts("ensemble, region"), _sessions("s", "ab", "ensemble, region", delta + 1), _events("g", "s", "ensemble, region"), "e AS (SELECT ensemble, region, count(*) AS n_ep FROM g GROUP BY ALL)", "cd AS (SELECT ensemble, region, CAST(sum(greatest(prec, trigg)) AS BIGINT) AS n_cd FROM m GROUP BY ALL)")
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT ensemble, region, CAST({threshold} AS DOUBLE) AS wet_threshold, {delta} AS \"delT\", 1 AS tau, 'poisson' AS sigtest, t_len AS n_jjas_days, n_a AS n_events, round(n_a / t_len, 9) AS p_wet, k_prec AS k_precursor, k_trigg AS k_trigger, round(k_prec / nullif(n_a, 0), 9) AS precursor_rate, round(k_trigg / nullif(n_b, 0), 9) AS trigger_rate, round({_tail('n_a', _p('n_b', delta, 1), 'k_prec')}, 9) AS pvalue_precursor, round({_tail('n_b', _p('n_a', delta, 1), 'k_trigg')}, 9) AS pvalue_trigger, n_cd AS n_compound_days, n_a - n_cd AS n_single_days, coalesce(n_ep, 0) AS n_compound_episodes FROM tot JOIN cd USING (ensemble, region) LEFT JOIN e USING (ensemble, region))"


@query(_sql(ORDERS, AXIS, MEMBERS, " UNION ALL ".join(_sweep_sql(x, t) for x in SWEEP.deltas for t in SWEEP.thresholds)))
def pipeline_summary(spark, d):
    out = sweep.summary(sweep.flagged(members(spark, d), SWEEP), SWEEP)
    return rounded(out, **dict.fromkeys(("p_wet", "precursor_rate", "trigger_rate", "pvalue_precursor", "pvalue_trigger"), 9))


# --- gridded fields ---------------------------------------------------------------------------------------------------

CLIM = "cl AS (SELECT member, lat, lon, avg(value) AS value, count(DISTINCT yyyymmdd) AS n_days FROM f WHERE yyyymmdd BETWEEN '19950101' AND '19991231' AND substr(yyyymmdd, 5, 2) IN ('06', '07', '08') GROUP BY ALL)"


def _clim(spark: SparkSession, d: str) -> DataFrame:
    return fields.climatology(gridded(spark, d), "19950101", "19991231", (6, 7, 8))


@query(_sql(ORDERS, FIELD, CLIM, "SELECT member, lat, lon, round(value, 6) AS value, n_days FROM cl"))
def climatology_period(spark, d):
    return rounded(_clim(spark, d), value=6)


@query(_sql(ORDERS, FIELD, "SELECT member, substr(yyyymmdd, 5, 4) AS mmdd, lat, lon, round(avg(value), 6) AS value FROM f WHERE yyyymmdd BETWEEN '19950101' AND '19991231' GROUP BY ALL"))
def climatology_dayofyear(spark, d):
    return rounded(fields.climatology(gridded(spark, d), "19950101", "19991231", kind="dayofyear"), value=6)


def _dates(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a member's value is high anywhere, ten days of the 360-day calendar later."""
    high = wet(spark, d).where((F.col("event") == 1) & F.col("month").isin(6, 7, 8)).select(F.col("ensemble").alias("member"), "yyyymmdd")
    return fields.selected_dates(high, (6, 7), (1996, 2000), 10)


DATES = "dt AS (SELECT DISTINCT member, printf('%04d%02d%02d', CAST(floor(t / 360) AS INT), CAST(t % 360 // 30 + 1 AS INT), CAST(t % 30 + 1 AS INT)) AS yyyymmdd FROM (SELECT ensemble AS member, year * 360 + (month - 1) * 30 + CAST(substr(yyyymmdd, 7, 2) AS INT) - 1 + 10 AS t FROM wet WHERE event = 1 AND month IN (6, 7) AND year BETWEEN 1996 AND 2000))"
COMPOSITE = "co AS (SELECT member, lat, lon, avg(value) AS value, count(DISTINCT yyyymmdd) AS n_days FROM f SEMI JOIN dt USING (member, yyyymmdd) GROUP BY ALL)"
ANOMALY = "an AS (SELECT co.member, co.lat, co.lon, co.value - cl.value AS value, co.n_days FROM co LEFT JOIN cl ON co.member = cl.member AND co.lat = cl.lat AND co.lon = cl.lon)"
FIELDS = (*BASE, FIELD, CLIM, DATES, COMPOSITE, ANOMALY)
MEAN = ("nt AS (SELECT sum(n) AS total FROM (SELECT member, max(n_days) AS n FROM an GROUP BY member))", "em AS (SELECT lat, lon, sum(coalesce(value, 0) * n_days / (SELECT total FROM nt)) AS value FROM an GROUP BY ALL)")


def _anomaly(spark: SparkSession, d: str) -> DataFrame:
    return fields.anomaly(gridded(spark, d), _dates(spark, d), _clim(spark, d))


@query(_sql(*FIELDS, "SELECT member, lat, lon, round(value, 6) AS value, n_days FROM co"))
def composite_lagged(spark, d):
    return rounded(fields.composite(gridded(spark, d), _dates(spark, d)), value=6)


@query(_sql(*FIELDS, "SELECT member, lat, lon, round(value, 6) AS value, n_days FROM an"))
def composite_anomaly(spark, d):
    return rounded(_anomaly(spark, d), value=6)


@query(_sql(*FIELDS, "SELECT member, yyyymmdd FROM dt ANTI JOIN f USING (member, yyyymmdd)"))
def missing_dates(spark, d):
    return fields.missing_dates(gridded(spark, d), _dates(spark, d))


@query(_sql(*FIELDS, *MEAN, "SELECT lat, lon, round(value, 5) AS value FROM em"))
def ensemble_weighted_mean(spark, d):
    return rounded(fields.ensemble_mean(_anomaly(spark, d)), value=5)


AGREE = "ag AS (SELECT lat, lon, any_value(em.value) AS value, count(*) FILTER (WHERE sign(an.value) = sign(em.value)) AS n_agree, (SELECT count(DISTINCT member) FROM an) AS m FROM an JOIN em USING (lat, lon) GROUP BY ALL)"


@query(_sql(*FIELDS, *MEAN, AGREE, "SELECT lat, lon, round(value, 5) AS value, n_agree, round(n_agree / m, 9) AS fraction, n_agree >= greatest(2, ceil(0.8 * m - 1e-9)) AS agrees FROM ag"))
def sign_agreement(spark, d):
    return rounded(fields.sign_agreement(_anomaly(spark, d)), value=5, fraction=9)


@query(_sql(*FIELDS, *MEAN, AGREE, "SELECT round(min(value), 5) AS least, round(max(value), 5) AS largest, round(avg(CASE WHEN abs(value) > 1 THEN 100.0 ELSE 0 END), 6) AS percent_beyond_1, round(avg(CASE WHEN n_agree >= greatest(2, ceil(0.8 * m - 1e-9)) THEN 100.0 ELSE 0 END), 6) AS percent_agreeing, round(quantile_cont(value, 0.01), 5) AS p01, round(quantile_cont(value, 0.99), 5) AS p99 FROM ag"))
def field_diagnostics(spark, d):
    return rounded(fields.diagnostics(fields.sign_agreement(_anomaly(spark, d))), least=5, largest=5, percent_beyond_1=6, percent_agreeing=6, p01=5, p99=5)


@query(_sql(ORDERS, FIELD, "SELECT count(*) AS n, round(sum(value), 4) AS total FROM f WHERE lat BETWEEN 1 AND 3 AND lon BETWEEN 0 AND 2"))
def field_box(spark, d):
    return fields.in_box(gridded(spark, d), (360.0, 362.0), (1.0, 3.0)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- the minimal slice ------------------------------------------------------------------------------------------------


@query(_sql(*BASE_R, _sessions("s", "wetr", "region", 5), _events("g", "s", "region"), f"SELECT region, block, {EVENT_COLS}, n_extreme_cases FROM g"))
def regional_events(spark, d):
    """Daily values of each region, flagged, in summer blocks, as compound events."""
    return events.compound_events(wet_region(spark, d), R, 4, 1)
