"""Event coincidence analysis: counts, rates and significance from range frames.

Input rows are (keys, block, idx, a, b) with a and b 0 or 1. Frames are partitioned by block, which clips windows there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormspan.functions import nulls
from stormspan.functions.calendar import check_int

COUNTS = ("n_a", "n_b", "k_prec", "k_trigg")


def checked(series: DataFrame) -> DataFrame:
    """Raises an error for values other than 0 and 1 when they are read."""
    return series.withColumns({c: F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} must hold 0 and 1 only")).cast("int")) for c in ("a", "b")})


def marks(series: DataFrame, keys: Sequence[str], delta: int = 0, tau: int = 0, sym: bool = False) -> DataFrame:
    """series (days in a block) with prec (an a event with a b event shortly before) and trigg (a b event with an a event shortly after)."""
    check_int(delta, "delta", 0)
    check_int(tau, "tau", 0)
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    more = delta if sym else 0
    prec = F.max("b").over(w.rangeBetween(-tau - delta, -tau + more))
    trigg = F.max("a").over(w.rangeBetween(tau - more, tau + delta))
    return checked(series.where("block IS NOT NULL")).withColumns({"prec": F.coalesce((F.col("a") == 1) & (prec == 1), F.lit(False)).cast("int"), "trigg": F.coalesce((F.col("b") == 1) & (trigg == 1), F.lit(False)).cast("int")})


def block_counts(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each block: t_len, n_a, n_b, k_prec, k_trigg."""
    return marked.groupBy(*keys, "block").agg(F.count("*").alias("t_len"), *(F.sum(c).alias(n) for c, n in zip(("a", "b", "prec", "trigg"), COUNTS, strict=True)))


def analyse(series: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1, sym: bool = False, null_model: str | None = "pooled", alpha: float | None = None) -> DataFrame:
    """A row for each key: t_len, counts, rates and p-values (pooled binomial, exact sum of the blocks' binomials, or none for null_model None).

    alpha: adds null_prec and null_trigg, whether the null hypothesis stands (false where it can't be tested).
    """
    if null_model not in ("pooled", "blocked", None):
        raise ValueError(f"null_model is {null_model!r}; it can be pooled, blocked or None")
    keys = list(keys)
    return judged(block_counts(marks(series, keys, delta, tau, sym), keys), keys, delta, tau, sym, null_model, alpha)


def judged(blocks: DataFrame, keys: Sequence[str], delta: int | Column = 4, tau: int = 1, sym: bool = False, null_model: str | None = "pooled", alpha: float | None = None, sums: Sequence[str] = ()) -> DataFrame:
    """analyse from the counts of each block; delta may be one of the keys. sums: more columns of the blocks to add up."""
    keys = list(keys)
    p_prec, p_trigg = (nulls.success_probability(F.col("t_len"), F.col(c), delta, tau, sym) for c in ("n_b", "n_a"))
    totals = [F.sum(c).alias(c) for c in ("t_len", *COUNTS, *sums)]
    if null_model == "blocked":
        trials = blocks.withColumns({"_tp": F.array_repeat(p_prec, F.col("n_a").cast("int")), "_tt": F.array_repeat(p_trigg, F.col("n_b").cast("int"))})
        out = trials.groupBy(*keys).agg(*totals, F.flatten(F.collect_list("_tp")).alias("_tp"), F.flatten(F.collect_list("_tt")).alias("_tt"))
        out = out.withColumns({"_tp": nulls.success_counts("_tp"), "_tt": nulls.success_counts("_tt")})
        out = out.withColumns({"pvalue_prec": nulls.pmf_tail("_tp", "k_prec"), "pvalue_trigg": nulls.pmf_tail("_tt", "k_trigg")}).drop("_tp", "_tt")
    else:
        out = blocks.groupBy(*keys).agg(*totals)
        if null_model:
            out = out.withColumns({"_pp": p_prec, "_pt": p_trigg})
            out = out.withColumns({"pvalue_prec": nulls.binomial_tail("n_a", "_pp", "k_prec"), "pvalue_trigg": nulls.binomial_tail("n_b", "_pt", "k_trigg")}).drop("_pp", "_pt")
        else:
            out = out.withColumns({c: F.lit(None).cast("double") for c in ("pvalue_prec", "pvalue_trigg")})
    out = out.withColumns({"rate_prec": F.try_divide("k_prec", "n_a"), "rate_trigg": F.try_divide("k_trigg", "n_b")})
    if alpha is not None:
        out = out.withColumns({f"null_{c}": F.coalesce(F.col(f"pvalue_{c}") >= alpha, F.lit(False)) for c in ("prec", "trigg")})
    return out


def indices(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, prec_indices, trigg_indices."""
    return marked.groupBy(*keys).agg(*(F.array_sort(F.collect_list(F.when(F.col(c) == 1, F.col("idx")))).alias(f"{c}_indices") for c in ("prec", "trigg")))


def summary_table(result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, quantity, value: eight rows for each row of analyse."""
    shown = {"N events A": "n_a", "N events B": "n_b", "K precursor": "k_prec", "K trigger": "k_trigg", "precursor rate": "rate_prec", "trigger rate": "rate_trigg", "p-value precursor": "pvalue_prec", "p-value trigger": "pvalue_trigg"}
    pairs = ", ".join(f"'{k}', cast({v} as double)" for k, v in shown.items())
    return result.select(*keys, F.expr(f"stack({len(shown)}, {pairs}) AS (quantity, value)"))


def null_band(series: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1, sym: bool = False, null_model: str = "pooled", low: float = 0.025, high: float = 0.975, interpolate: bool = True) -> DataFrame:
    """keys, k_trigg, band_lo, band_hi, significant: the trigger count and the band of its null distribution."""
    keys = list(keys)
    blocks = block_counts(marks(series, keys, delta, tau, sym), keys)
    totals = blocks.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("t_len", *COUNTS)))
    pmf = nulls.null_pmf(totals if null_model == "pooled" else blocks, keys, delta, tau, sym)
    out = totals.join(pmf, keys).withColumns({"band_lo": nulls.pmf_quantile("pmf", low, interpolate), "band_hi": nulls.pmf_quantile("pmf", high, interpolate)})
    return out.select(*keys, "k_trigg", "band_lo", "band_hi", (F.col("k_trigg") > F.col("band_hi")).cast("int").alias("significant"))


def self_marks(series: DataFrame, keys: Sequence[str], tau: int = 1) -> DataFrame:
    """Days in a block with `back` and `ahead`: how far the next event that lies tau or more days before or after is, for events only. All delays are comparisons with these."""
    check_int(tau, "tau", 0)
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    at = F.when(F.col("event") == 1, F.col("idx"))
    before, after = F.max(at).over(w.rangeBetween(Window.unboundedPreceding, -tau)), F.min(at).over(w.rangeBetween(tau, Window.unboundedFollowing))
    return series.where("block IS NOT NULL").withColumns({"back": at - before, "ahead": after - at})


def self_counts(series: DataFrame, keys: Sequence[str], deltas: Sequence[int], tau: int = 1) -> DataFrame:
    """A row for each block and delta (keys, block, delT, t_len, counts of an event series with itself, n_members: events in any coincidence, n_starts: those with a later but no earlier one), from one pass."""
    marked, one = self_marks(series, keys, tau), F.lit(1)
    per = []
    for delta in deltas:
        check_int(delta, "delta", 0)
        prec, trigg = (F.coalesce(F.col(c) <= tau + delta, F.lit(False)) for c in ("back", "ahead"))
        sums = {"k_prec": prec, "k_trigg": trigg, "n_members": prec | trigg, "n_starts": trigg & ~prec}
        per.append(F.struct(F.lit(delta).alias("delT"), *(F.count(F.when(v, one)).alias(k) for k, v in sums.items())))
    blocks = marked.groupBy(*keys, "block").agg(F.count("*").alias("t_len"), F.sum("event").alias("n_a"), F.array(*per).alias("_per"))
    return blocks.select(*keys, "block", "t_len", "n_a", F.col("n_a").alias("n_b"), F.inline("_per"))


def drawn(seed: Column, length: Column, n: Column) -> Column:
    """n different numbers from 1 to length, any such set equally likely (Floyd's method): the j-th draw is below j, and j itself if it was drawn before. Draws are digits of an MD5 of seed and j."""
    digits = lambda j: F.conv(F.substring(F.md5(F.concat_ws("/", seed, j.cast("string"))), 1, 12), 16, 10).cast("long")
    steps = F.when(n > 0, F.sequence(length - n + 1, length)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.array().cast("array<bigint>"), lambda held, j: F.transform(F.array(F.pmod(digits(j), j) + 1), lambda t: F.concat(held, F.array(F.when(F.array_contains(held, t), j).otherwise(t))))[0])


def shuffle_test(series: DataFrame, keys: Sequence[str], delta: int = 4, tau: int = 1, sym: bool = False, reps: int = 100, seed: int = 42) -> DataFrame:
    """keys, pvalue_prec, pvalue_trigg: share of surrogates, with events placed anew within their blocks, whose rate is above the observed one.

    A surrogate of a block is drawn from the block's number of events alone, so the work grows with surrogates and events,
    not with days. Draws follow from (seed, series, keys, block, surrogate), so the result is the same on every run.
    """
    check_int(reps, "reps", 1)
    keys, more = list(keys), delta if sym else 0
    rows = checked(series.where("block IS NOT NULL")).select(*keys, "block", "idx", "a", "b")
    observed = analyse(rows, keys, delta, tau, sym, None).select(*keys, F.col("rate_prec").alias("_op"), F.col("rate_trigg").alias("_ot"), "n_a", "n_b")
    blocks = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("idx")).alias("_days"), *(F.sum(c).alias(f"_n{c}") for c in "ab"))

    def placed(c: str, rep: Column) -> Column:
        name = F.concat_ws("/", F.lit(f"{seed}{c}"), *[F.col(k).cast("string") for k in (*keys, "block")], rep.cast("string"))
        return F.transform(drawn(name, F.size("_days").cast("long"), F.col(f"_n{c}").cast("long")), lambda i: F.get("_days", (i - 1).cast("int")))

    def counted(rep: Column) -> Column:
        def both(x: Column) -> Column:
            near = lambda own, other, lo, hi: F.size(F.filter(own, lambda i: F.exists(other, lambda j: (j - i).between(lo, hi))))
            return F.struct(rep.alias("rep"), near(x["a"], x["b"], -tau - delta, -tau + more).alias("k_prec"), near(x["b"], x["a"], tau - more, tau + delta).alias("k_trigg"))

        return F.transform(F.array(F.struct(placed("a", rep).alias("a"), placed("b", rep).alias("b"))), both)[0]

    surrogates = blocks.select(*keys, F.inline(F.transform(F.sequence(F.lit(1), F.lit(reps)), counted))).groupBy(*keys, "rep").agg(F.sum("k_prec").alias("k_prec"), F.sum("k_trigg").alias("k_trigg"))
    both = surrogates.join(observed, keys)
    share = {c: F.when(F.min(F.least("n_a", "n_b")) > 0, F.avg((F.try_divide(f"k_{c}", n) > F.col(f"_o{c[0]}")).cast("double"))) for c, n in (("prec", "n_a"), ("trigg", "n_b"))}
    return both.groupBy(*keys).agg(*(v.alias(f"pvalue_{c}") for c, v in share.items()))
