"""Spend-response curves over same-day attribution: incrementality proxy (A24), returns by
spend quartile (A25), efficiency curve by spend decile (A28).

Rows are ordered per channel by (spend, date); bins follow the floor rule on integers. Daily rows
are numbered by a window, whose partitions the calendar bounds. With ``any_size=True`` the ends of the
bins are found by histograms of counts instead (see ``bins``), for channels of any number of rows;
the results are the same.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.columns import guarded_ratio
from spendlens.functions.exact import average
from spendlens.operators.attribution import attributed_fact
from spendlens.operators.bins import bin_ends, lowest_end, segments
from spendlens.operators.ranking import equal_count_bin, in_lowest_fraction, rank_within


def _same_day(spend: DataFrame, revenue: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attributed_fact(spend, revenue, (1,), keys).select(*keys, "date", "channel", "spend", "attributed_revenue")


def ranked_same_day(spend: DataFrame, revenue: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Same-day attributed rows with rn (by spend, then date) and n per (keys, channel)."""
    return rank_within(_same_day(spend, revenue, keys), [*keys, "channel"], ["spend", "date"])


def incrementality(spend: DataFrame, revenue: DataFrame, keys: Sequence[str] = (), lowest_parts: int = 10,
                   any_size: bool = False) -> DataFrame:
    """(channel, baseline_attr_rev, higher_spend_attr_rev, abs_lift, pct_lift): mean attributed
    revenue on the lowest-spend tenth of days (rn <= n / 10) versus the rest."""
    if any_size:
        r = segments(_same_day(spend, revenue, keys), [*keys, "channel"], ["spend", "date"],
                     lambda n: lowest_end(n, lowest_parts), "part")
        r = r.withColumn("low", F.col("part") == 0)
    else:
        r = ranked_same_day(spend, revenue, keys)
        r = r.withColumn("low", in_lowest_fraction("rn", "n", lowest_parts))
    g = r.groupBy(*keys, "channel").agg(
        average(r, "attributed_revenue", "CASE WHEN low THEN attributed_revenue END").alias("baseline_attr_rev"),
        average(r, "attributed_revenue", "CASE WHEN NOT low THEN attributed_revenue END").alias("higher_spend_attr_rev"))
    lift = F.col("higher_spend_attr_rev") - F.col("baseline_attr_rev")
    return (g.select(*keys, "channel", "baseline_attr_rev", "higher_spend_attr_rev", lift.alias("abs_lift"),
                     F.when(F.col("baseline_attr_rev") > 0, lift * 100 / F.col("baseline_attr_rev")).alias("pct_lift"))
            .orderBy(*keys, "channel"))


def _binned(spend, revenue, keys, bins, bin_col, any_size) -> DataFrame:
    if any_size:
        r = segments(_same_day(spend, revenue, keys), [*keys, "channel"], ["spend", "date"], lambda n: bin_ends(n, bins),
                     bin_col)
        return r.withColumn(bin_col, F.col(bin_col) + 1)
    r = ranked_same_day(spend, revenue, keys)
    return r.withColumn(bin_col, equal_count_bin("rn", "n", bins))


def return_by_quartile(spend: DataFrame, revenue: DataFrame, keys: Sequence[str] = (),
                       any_size: bool = False) -> DataFrame:
    """(channel, quartile, avg_spend, avg_attr_revenue, avg_roas); avg_roas is a ratio of means."""
    b = _binned(spend, revenue, keys, 4, "quartile", any_size)
    return (b.groupBy(*keys, "channel", "quartile")
            .agg(average(b, "spend").alias("avg_spend"), average(b, "attributed_revenue").alias("avg_attr_revenue"))
            .withColumn("avg_roas", guarded_ratio("avg_attr_revenue", "avg_spend"))
            .orderBy(*keys, "channel", "quartile"))


def efficiency_curve(spend: DataFrame, revenue: DataFrame, keys: Sequence[str] = (), bins: int = 10,
                     any_size: bool = False) -> DataFrame:
    """(channel, decile, avg_spend, avg_attr_rev, avg_roas); a zero mean spend gives NULL ROAS."""
    b = _binned(spend, revenue, keys, bins, "decile", any_size)
    return (b.groupBy(*keys, "channel", "decile")
            .agg(average(b, "spend").alias("avg_spend"), average(b, "attributed_revenue").alias("avg_attr_rev"))
            .withColumn("avg_roas", F.try_divide(F.col("avg_attr_rev"), F.col("avg_spend")))
            .orderBy(*keys, "channel", "decile"))
