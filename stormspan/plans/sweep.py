"""The batch analysis: thresholds x delays over all members and regions, with its four outputs."""

from __future__ import annotations

import argparse
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormspan.functions.calendar import calendar_block, check_linkage
from stormspan.operators import coincidence, events
from stormspan.operators.flagging import flag_extremes

KEYS = ["ensemble", "region", "wet_threshold"]


@dataclass(frozen=True)
class SweepConfig:
    thresholds: tuple[float, ...] = (20.0, 24.0, 28.0)
    deltas: tuple[int, ...] = (1, 2, 3, 4)
    tau: int = 1
    spell: int = 1
    months: tuple[int, ...] = (6, 7, 8, 9)
    null_model: str = "pooled"
    sigtest: str = "poisson"
    reps: int = 1000
    seed: int = 42
    detector: Callable[[DataFrame, Sequence[str], object, int], DataFrame] | None = field(default=None, compare=False)


def flagged(series: DataFrame, config: SweepConfig) -> DataFrame:
    """In-season days of every threshold with their flags, found within blocks."""
    days = series.withColumn("block", calendar_block(F.col("year"), F.col("month"), config.months)).where("block IS NOT NULL")
    many = days.withColumn("wet_threshold", F.explode(F.array(*[F.lit(float(t)) for t in config.thresholds])))
    detect = config.detector or (lambda d, k, limit, n: flag_extremes(d, k, limit, n))
    return detect(many, [*KEYS, "block"], F.col("wet_threshold"), config.spell)


def _each(config: SweepConfig, one: Callable[[int], DataFrame]) -> DataFrame:
    out = None
    for delta in config.deltas:
        own = one(delta).withColumn("delT", F.lit(delta))
        out = own if out is None else out.unionByName(own)
    return out


def summary(marked: DataFrame, config: SweepConfig) -> DataFrame:
    """One row for each key and delay. All delays come from one pass over the days, since each compares the same distances."""
    check_linkage(min(config.deltas), config.tau)
    keys = [*KEYS, "delT"]
    blocks = coincidence.self_counts(marked, KEYS, config.deltas, config.tau)
    shuffled = config.sigtest == "shuffle.surrogate"
    out = coincidence.judged(blocks, keys, F.col("delT"), config.tau, False, None if shuffled else config.null_model, sums=("n_members", "n_starts"))
    if shuffled:
        both = marked.withColumns({"a": F.col("event"), "b": F.col("event")})
        tests = _each(config, lambda delta: coincidence.shuffle_test(both, KEYS, delta, config.tau, False, config.reps, config.seed))
        out = out.drop("pvalue_prec", "pvalue_trigg").join(tests, keys)
    if config.tau == 1:  # an episode begins at each event that has a later one near it but no earlier one
        out = out.withColumn("n_compound_episodes", F.col("n_starts"))
    else:
        compound = _each(config, lambda delta: events.compound_events(marked, KEYS, delta, config.tau).groupBy(*KEYS).agg(F.count("*").alias("n_compound_episodes")))
        out = out.join(compound, keys, "left")
    out = out.withColumnRenamed("n_members", "n_compound_days")
    n, zero = F.col("n_compound_days"), F.coalesce("n_compound_episodes", F.lit(0).cast("long"))
    return out.select("ensemble", "region", "wet_threshold", "delT", F.lit(config.tau).alias("tau"), F.lit(config.sigtest).alias("sigtest"), F.col("t_len").alias("n_jjas_days"), F.col("n_a").alias("n_events"), F.try_divide("n_a", "t_len").alias("p_wet"), F.col("k_prec").alias("k_precursor"), F.col("k_trigg").alias("k_trigger"), F.col("rate_prec").alias("precursor_rate"), F.col("rate_trigg").alias("trigger_rate"), F.col("pvalue_prec").alias("pvalue_precursor"), F.col("pvalue_trigg").alias("pvalue_trigger"), n.alias("n_compound_days"), (F.col("n_a") - n).alias("n_single_days"), zero.alias("n_compound_episodes"))


def regional_episodes(marked: DataFrame, config: SweepConfig) -> DataFrame:
    return _each(config, lambda delta: events.episodes(marked, KEYS, delta, config.tau))


def national_episodes(marked: DataFrame, config: SweepConfig) -> DataFrame:
    return _each(config, lambda delta: events.national_episodes(marked, ["ensemble", "wet_threshold"], delta, config.tau))


def day_classes(marked: DataFrame, config: SweepConfig) -> DataFrame:
    return _each(config, lambda delta: events.classify_days(marked, KEYS, ["ensemble", "wet_threshold"], delta, config.tau))


def run(series: DataFrame, config: SweepConfig, out: str | None = None) -> dict[str, DataFrame]:
    """The four outputs, lazily; with `out` they are written below it as CSV, from one flagged table that is kept between them."""
    marked = flagged(series, config)
    if out is not None:
        marked = marked.persist()
    found = {"summary": summary(marked, config), "regional_episodes": regional_episodes(marked, config), "national_episodes": national_episodes(marked, config), "events_by_day": day_classes(marked, config)}
    if out is not None:
        for name, table in found.items():
            writer = table.write.mode("overwrite").option("header", True)
            (writer.partitionBy("ensemble", "wet_threshold", "delT") if name == "events_by_day" else writer).csv(f"{out}/{name}")
        marked.unpersist()
    return found


def main(argv: Sequence[str] | None = None) -> None:
    """spark-submit entry point."""
    a = arguments().parse_args(argv)
    from stormspan.sources.io import read_series

    names = None if a.ensembles is None else [a.ensemble_prefix + e for e in a.ensembles]
    series = read_series(SparkSession.builder.getOrCreate(), a.series, names, a.regions)
    if a.ensemble_prefix:
        series = series.withColumn("ensemble", F.regexp_replace("ensemble", f"^{re.escape(a.ensemble_prefix)}", ""))
    run(series, configured(a), a.out)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--series", required=True, help="Parquet of the series, partitioned by ensemble and region")
    p.add_argument("--out", required=True)
    p.add_argument("--ensembles", nargs="*")
    p.add_argument("--ensemble-prefix", default="", help="stands before the members' names in the series, and is left out of the outputs")
    p.add_argument("--regions", nargs="*")
    p.add_argument("--thresholds", nargs="*", type=float, default=[20.0, 24.0, 28.0])
    p.add_argument("--delT", nargs="*", type=int, default=[1, 2, 3, 4])
    p.add_argument("--tau", type=int, default=1)
    p.add_argument("--len-wet", type=int, default=1)
    p.add_argument("--season", nargs="+", type=int, default=[6, 7, 8, 9], help="months to keep; blocks are calendar years")
    p.add_argument("--null-model", choices=["pooled", "blocked"], default="pooled")
    p.add_argument("--sigtest", choices=["poisson", "shuffle.surrogate"], default="poisson")
    p.add_argument("--shuffle-reps", type=int, default=1000)
    p.add_argument("--seed", type=int, default=42, help="of the surrogates")
    return p


def configured(a: argparse.Namespace) -> SweepConfig:
    return SweepConfig(tuple(a.thresholds), tuple(a.delT), a.tau, a.len_wet, tuple(a.season), a.null_model, a.sigtest, a.shuffle_reps, a.seed)


if __name__ == "__main__":
    main()
