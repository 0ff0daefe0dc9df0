"""Extreme-event analytics and large-corpus data preparation on Spark DataFrames.

The names here are the public interface; `stormspan.llm` holds the corpus operators and is imported by itself.
"""

from stormspan.functions import calendar, nulls
from stormspan.functions.calendar import calendar_block, periods_table, season_months, season_year, with_blocks
from stormspan.functions.nulls import null_pmf
from stormspan.operators.coincidence import analyse, indices, marks, null_band, self_counts, shuffle_test, summary_table
from stormspan.operators.events import classify_days, compound_events, cooccurring_events, episodes, membership, national_episodes, national_series, sequential_events, spells
from stormspan.operators.fields import anomaly, climatology, composite, ensemble_mean, sign_agreement
from stormspan.operators.flagging import compare_flags, flag_extremes, flag_percentile, matched_thresholds, percentile_rank
from stormspan.operators.stats import agreement, annual_stats, annual_stats_by_variable, ensemble_summary, flag_annual_stats, hover_text, hovmoller, pivoted, regional_means
from stormspan.operators.windows import WindowConfig, analyse_windows, rolling_coincidence
from stormspan.plans.sweep import SweepConfig, run
from stormspan.sources.io import array_detector, read_fields, read_series, table_detector, write_csv, write_fields, write_series

__all__ = [
    "SweepConfig", "WindowConfig", "agreement", "analyse", "analyse_windows", "annual_stats", "annual_stats_by_variable", "anomaly", "array_detector",
    "calendar", "calendar_block", "classify_days", "climatology", "compare_flags", "composite", "compound_events", "cooccurring_events", "ensemble_mean",
    "ensemble_summary", "episodes", "flag_annual_stats", "flag_extremes", "flag_percentile", "hover_text", "hovmoller", "indices", "marks", "matched_thresholds",
    "membership", "national_episodes", "national_series", "null_band", "null_pmf", "nulls", "percentile_rank", "periods_table", "pivoted", "read_fields", "read_series",
    "regional_means", "rolling_coincidence", "run", "season_months", "season_year", "self_counts", "sequential_events", "shuffle_test", "sign_agreement", "spells",
    "summary_table", "table_detector", "with_blocks", "write_csv", "write_fields", "write_series",
]
