"""Compound events, episodes and spells: sessions of flagged days within blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormspan.functions.calendar import check_int, check_linkage
from stormspan.operators import coincidence


def sessions(days: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Adds `session` to flagged days: consecutive ones at most `gap` positions apart within a block."""
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    new = F.coalesce((F.col("idx") - F.lag("idx").over(w) > gap).cast("int"), F.lit(1))
    return days.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def linked(days: DataFrame, keys: Sequence[str], delta: int, tau: int) -> DataFrame:
    """Adds `session` to flagged days: components of the graph that joins days of a block tau to tau + delta apart.

    With tau of 0 or 1 these are sessions. Beyond, days closer than tau may belong to different components: a fold over a
    block's days carries the labels, which a season's length bounds.
    """
    check_int(delta, "delta", 0)
    check_int(tau, "tau", 0)
    if tau <= 1:
        return sessions(days, keys, tau + delta)
    near = f"filter(acc, e -> x - e.pos BETWEEN {tau} AND {tau + delta}).lab"
    step = f"transform(array({near}), n -> concat(transform(acc, e -> named_struct('pos', e.pos, 'lab', if(array_contains(n, e.lab), array_min(n), e.lab))), array(named_struct('pos', x, 'lab', coalesce(array_min(n), x)))))[0]"
    fold = f"aggregate(_p, cast(array() as array<struct<pos:int,lab:int>>), (acc, x) -> {step})"
    labels = days.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.col("idx").cast("int"))).alias("_p")).select(*keys, "block", F.inline(F.expr(fold)))
    return days.join(labels.select(*keys, "block", F.col("pos").alias("idx"), F.col("lab").cast("long").alias("session")), [*keys, "block", "idx"])


def flagged(series: DataFrame) -> DataFrame:
    return series.where((F.col("event") == 1) & F.col("block").isNotNull())


def membership(series: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1) -> DataFrame:
    """Flagged days with another flagged day tau to tau + delta before or after, in the same block."""
    both = series.withColumns({"a": F.col("event"), "b": F.col("event")})
    return coincidence.marks(both, keys, delta, tau).where("prec = 1 OR trigg = 1").drop("a", "b", "prec", "trigg")


def compound_events(series: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1, min_duration: int = 2) -> DataFrame:
    """keys, block, start_idx, end_idx, length, n_extreme_cases of each compound event; a lone day is none, whatever min_duration."""
    check_linkage(delta, tau)
    check_int(min_duration, "min_duration", 1)
    grouped = linked(flagged(series), keys, delta, tau).groupBy(*keys, "block", "session").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("n_extreme_cases"))
    return grouped.where(F.col("n_extreme_cases") >= max(2, min_duration)).select(*keys, "block", "start_idx", "end_idx", (F.col("end_idx") - F.col("start_idx") + 1).alias("length"), "n_extreme_cases")


def paired(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two flagged series on the same days as keys, block, idx, e1, e2; a day of one only raises an error when it is read."""
    a = first.select(*keys, "block", "idx", F.col("event").alias("e1"))
    b = second.select(*keys, "idx", F.col("event").alias("e2"))
    both = a.join(b, [*keys, "idx"], "full_outer")
    return both.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit("both series must cover the same days")).cast("int")) for c in ("e1", "e2")})


def sequential_events(pair: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1, min_duration_1: int = 1, min_duration_2: int = 1) -> DataFrame:
    """Events of two variables in any order: sessions of days of either with enough days of each. A day of both counts twice."""
    check_linkage(delta, tau)
    days = pair.where("block IS NOT NULL AND (e1 = 1 OR e2 = 1)")
    grouped = sessions(days, keys, tau + delta).groupBy(*keys, "block", "session").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.sum("e1").alias("n_extreme_cases_1"), F.sum("e2").alias("n_extreme_cases_2"))
    kept = grouped.where((F.col("n_extreme_cases_1") >= min_duration_1) & (F.col("n_extreme_cases_2") >= min_duration_2))
    return kept.select(*keys, "block", "start_idx", "end_idx", (F.col("end_idx") - F.col("start_idx") + 1).alias("length"), (F.col("n_extreme_cases_1") + F.col("n_extreme_cases_2")).alias("n_extreme_cases"), "n_extreme_cases_1", "n_extreme_cases_2")


def cooccurring_events(pair: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1, min_duration: int = 1) -> DataFrame:
    """Events of days on which both variables are flagged; the counts of either variable cover the whole span.

    Running totals of either variable at the first and last day give the span's counts without a range join.
    """
    check_linkage(delta, tau)
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    days = pair.withColumns({"_t1": F.sum("e1").over(w), "_t2": F.sum("e2").over(w)}).where("block IS NOT NULL AND e1 = 1 AND e2 = 1")
    grouped = sessions(days, keys, tau + delta).groupBy(*keys, "block", "session").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("n_extreme_cases"), *((F.max(f"_t{k}") - F.min(f"_t{k}") + 1).alias(f"n_extreme_cases_{k}") for k in (1, 2)))
    return grouped.where(F.col("n_extreme_cases") >= min_duration).select(*keys, "block", "start_idx", "end_idx", (F.col("end_idx") - F.col("start_idx") + 1).alias("length"), "n_extreme_cases", "n_extreme_cases_1", "n_extreme_cases_2", F.col("n_extreme_cases").alias("n_coincident_cases"))


def episodes(series: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1, inclusive: bool = True, singles: bool = True, rain_days: bool = True, extra: dict[str, Column] | None = None) -> DataFrame:
    """keys, year (the block), event_type, start_index, end_index, start_yyyymmdd, end_yyyymmdd, duration, length[, rain_days] of compound and single episodes."""
    label = F.struct("idx", "yyyymmdd")
    more = {"rain_days": F.array_join(F.transform(F.array_sort(F.collect_list(label)), lambda x: x.yyyymmdd), ";")} if rain_days else {}
    more |= extra or {}
    grouped = linked(flagged(series), keys, delta, tau).groupBy(*keys, "block", "session").agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count("*").alias("duration"), *(v.alias(k) for k, v in more.items()))
    out = grouped if singles else grouped.where("duration >= 2")
    return out.select(*keys, F.col("block").alias("year"), F.when(F.col("duration") >= 2, "compound").otherwise("single").alias("event_type"), F.col("_lo.idx").alias("start_index"), F.col("_hi.idx").alias("end_index"), F.col("_lo.yyyymmdd").alias("start_yyyymmdd"), F.col("_hi.yyyymmdd").alias("end_yyyymmdd"), "duration", (F.col("_hi.idx") - F.col("_lo.idx") + (1 if inclusive else 0)).alias("length"), *more)


def national_series(series: DataFrame, keys: Sequence[str], region: str = "region") -> DataFrame:
    """One series over all regions: a day is flagged if any region is; idx counts the days in season; block is the calendar year; `regions` are the flagged ones."""
    days = series.where("block IS NOT NULL").groupBy(*keys, "yyyymmdd").agg(F.max("event").alias("event"), F.array_sort(F.collect_set(F.when(F.col("event") == 1, F.col(region)))).alias("regions"))
    order = Window.partitionBy(*keys).orderBy("yyyymmdd")
    return days.withColumns({"idx": F.row_number().over(order) - 1, "block": F.substring("yyyymmdd", 1, 4).cast("int")})


def national_episodes(series: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1, region: str = "region") -> DataFrame:
    """Episodes of national_series with the contributing regions."""
    regions = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("regions")))), ";")
    return episodes(national_series(series, keys, region), keys, delta, tau, extra={"regions": regions})


def classify_days(series: DataFrame, keys: Sequence[str], by: Sequence[str], delta: int = 4, tau: int = 1) -> DataFrame:
    """by, day_class, yyyymmdd: each in-season day as compound, single or no events over all keys beyond `by`; compound anywhere wins."""
    both = series.withColumns({"a": F.col("event"), "b": F.col("event")})
    marked = coincidence.marks(both, keys, delta, tau).withColumn("_c", F.greatest("prec", "trigg"))
    days = marked.groupBy(*by, "yyyymmdd").agg(F.max("_c").alias("_c"), F.max("event").alias("_e"))
    return days.select(*by, F.when(F.col("_c") == 1, "compound").when(F.col("_e") == 1, "single").otherwise("no events").alias("day_class"), "yyyymmdd")


def thinned(series: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Flagged days more than `reach` after the last kept one of their block (greedy)."""
    step = f"if(a.last IS NULL OR x - a.last > {reach}, named_struct('last', x, 'hits', concat(a.hits, array(x))), a)"
    fold = f"aggregate(_s, named_struct('last', cast(null as int), 'hits', cast(array() as array<int>)), (a, x) -> {step}, a -> a.hits)"
    near = sessions(flagged(series), keys, reach).groupBy(*keys, "block", "session").agg(F.array_sort(F.collect_list(F.col("idx").cast("int"))).alias("_s"))
    return near.select(*keys, "block", F.explode(F.expr(fold)).alias("idx"))


def expanded(kept: DataFrame, series: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Flagged days from a kept one to `reach` after it, in its block, each once."""
    days = kept.select(*keys, "block", F.explode(F.sequence("idx", F.col("idx") + reach)).alias("idx")).distinct()
    return flagged(series).select(*keys, "block", "idx").join(days, [*keys, "block", "idx"], "left_semi")


def spells(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, block, start_idx, end_idx, length of maximal runs of flagged days."""
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    runs = flagged(series).withColumn("_run", F.col("idx") - F.row_number().over(w))
    return runs.groupBy(*keys, "block", "_run").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("length")).drop("_run")


def union_events(found: DataFrame, series: DataFrame, keys: Sequence[str], by: Sequence[str], delta: int = 4, tau: int = 1, min_duration: int = 2) -> DataFrame:
    """Events of the union over all keys beyond `by`: every day of each event's span is a flagged day, and detection runs again."""
    days = found.select(*by, "block", F.explode(F.sequence("start_idx", "end_idx")).alias("idx")).distinct().withColumn("event", F.lit(1))
    return compound_events(days, by, delta, tau, min_duration)
