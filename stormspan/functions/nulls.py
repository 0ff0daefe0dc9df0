"""Null distributions of coincidence counts as column expressions.

Undefined probabilities are null. Tails are summed from small terms, never as one minus a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_share(t_len: Column, delta: int | Column, tau: int, sym: bool = False) -> Column:
    """Share of a series that a coincidence window covers; null where it can't be a probability's base."""
    delta = delta if isinstance(delta, Column) else F.lit(delta)
    share = F.try_divide(2 * delta + 1.0, t_len) if sym else F.try_divide(delta + 1.0, t_len - tau)
    return F.when((share >= 0) & (share <= 1), share)


def success_probability(t_len: Column, n_other: Column, delta: int | Column, tau: int, sym: bool = False) -> Column:
    """Chance that an event meets one of n_other events placed at random."""
    return 1 - F.pow(1 - window_share(t_len, delta, tau, sym), n_other)


def binomial_tail(n: str, p: str, k: str) -> Column:
    """P(X >= k) of a binomial with the named columns; null for n = 0."""
    step = f"ln(cast({n} - i + 1 as double)) - ln(cast(i as double)) + ln({p}) - ln(1 - {p})"
    fold = (
        f"aggregate(sequence(1, cast({n} as int)), named_struct('lp', {n} * ln(1 - {p}), 's', cast(0 as double)), "
        f"(a, i) -> named_struct('lp', a.lp + {step}, 's', a.s + if(i >= {k}, exp(a.lp + {step}), cast(0 as double))), a -> least(a.s, 1d))"
    )
    return F.expr(f"CASE WHEN {n} = 0 OR {p} IS NULL THEN NULL WHEN {k} <= 0 THEN 1d WHEN {p} <= 0 THEN 0d WHEN {p} >= 1 THEN if({k} <= {n}, 1d, 0d) ELSE {fold} END")


def success_counts(trials: str) -> Column:
    """PMF over 0 .. size of the number of successes among independent trials, an array column of probabilities."""
    return F.expr(f"aggregate({trials}, array(1d), (f, p) -> transform(sequence(0, size(f)), i -> coalesce(get(f, i), 0d) * (1 - p) + coalesce(get(f, i - 1), 0d) * p))")


def pmf_tail(pmf: str, k: str) -> Column:
    """P(K >= k) of a PMF array; null if there is no trial."""
    return F.expr(f"CASE WHEN size({pmf}) > 1 THEN aggregate(slice({pmf}, cast({k} as int) + 1, size({pmf})), 0d, (s, x) -> s + x) / aggregate({pmf}, 0d, (s, x) -> s + x) END")


def pmf_quantile(pmf: str, level: float, interpolate: bool = True) -> Column:
    """Quantile of a PMF array over 0, 1, ...: interpolated linearly on its distribution function, or the smallest count that reaches the level."""
    cdf = f"transform(sequence(1, size({pmf})), n -> aggregate(slice({pmf}, 1, n), 0d, (s, x) -> s + x) / aggregate({pmf}, 0d, (s, x) -> s + x))"
    first = f"coalesce(array_position(transform(c, x -> x >= {level!r}d), true), 0)"
    if not interpolate:
        body = f"cast(if(j = 0, size(c) - 1, j - 1) as double)"
    else:
        body = f"CASE WHEN j = 0 THEN cast(size(c) - 1 as double) WHEN j = 1 THEN 0d ELSE (j - 2) + ({level!r}d - c[cast(j - 2 as int)]) / (c[cast(j - 1 as int)] - c[cast(j - 2 as int)]) END"
    return F.expr(f"transform(array({cdf}), c -> transform(array({first}), j -> {body})[0])[0]")


def null_pmf(blocks: DataFrame, keys: list[str], delta: int, tau: int, sym: bool = False) -> DataFrame:
    """keys and pmf of the trigger count, from one row (t_len, n_a, n_b) for each block."""
    p = success_probability(F.col("t_len"), F.col("n_a"), delta, tau, sym)
    trials = blocks.withColumn("_t", F.array_repeat(p, F.when(F.col("n_b") > 0, F.col("n_b").cast("int")).otherwise(0)))
    return trials.groupBy(*keys).agg(F.flatten(F.collect_list("_t")).alias("trials")).select(*keys, success_counts("trials").alias("pmf"))
