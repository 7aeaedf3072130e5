"""Revenue drivers: spend-revenue correlation by channel (A20), lift on flagged days (A21),
revenue-seasonality correlation (A22), seasonality buckets (A23)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.exact import average
from spendlens.functions.joins import join_on
from spendlens.functions.stats import digits_of, pearson
from spendlens.operators.attribution import as_long

# Lift factor labels and the flag column each one reads.
LIFT_FACTORS = (("holiday", "is_holiday"), ("promotion", "promotion_active"), ("weekend", "is_weekend"))

# Seasonality bucket bounds and labels, in report order.
LOW_BOUND, HIGH_BOUND = 0.9, 1.1
BUCKETS = ("low_seasonality", "mid_seasonality", "high_seasonality")


def corr_spend_revenue(spend: DataFrame, revenue: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(channel, pearson_corr_spend_vs_revenue) over the dates present in both feeds."""
    j = join_on(as_long(spend, keys).select(*keys, "date", "channel", "spend"), revenue.select(*keys, "date", "revenue"),
                keys)
    r = pearson("spend", "revenue", digits_of(j, "spend"), digits_of(j, "revenue"))
    return (j.groupBy(*keys, "channel").agg(r.alias("pearson_corr_spend_vs_revenue"))
            .orderBy(*keys, "channel"))


def _revenue_factors(revenue: DataFrame, factors: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return join_on(factors.select(*keys, "date", *cols), revenue.select(*keys, "date", "revenue"), keys)


def revenue_lift(revenue: DataFrame, factors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(factor, avg_control, avg_treated, abs_lift, pct_lift): mean revenue on flag = 1 vs 0 days.

    The three flags become rows first, so one aggregation keyed by factor serves all.
    Days whose flag is NULL count in neither arm.
    """
    j = _revenue_factors(revenue, factors, keys, [c for _, c in LIFT_FACTORS])
    long = j.select(*keys, "revenue", F.inline(F.array(*[
        F.struct(F.lit(name).alias("factor"), F.col(col).alias("flag")) for name, col in LIFT_FACTORS])))
    g = long.groupBy(*keys, "factor").agg(
        average(long, "revenue", "CASE WHEN flag = 0 THEN revenue END").alias("avg_control"),
        average(long, "revenue", "CASE WHEN flag = 1 THEN revenue END").alias("avg_treated"))
    lift = F.col("avg_treated") - F.col("avg_control")
    return (g.select(*keys, "factor", "avg_control", "avg_treated", lift.alias("abs_lift"),
                     F.when(F.col("avg_control") > 0, lift * 100 / F.col("avg_control")).alias("pct_lift"))
            .orderBy(*keys, "factor"))


def corr_revenue_seasonality(revenue: DataFrame, factors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per key): pearson_corr_revenue_vs_seasonality_index."""
    j = _revenue_factors(revenue, factors, keys, ["seasonality_index"])
    g = j.groupBy(*keys) if keys else j.groupBy()
    r = pearson("seasonality_index", "revenue", digits_of(j, "seasonality_index"), digits_of(j, "revenue"))
    return g.agg(r.alias("pearson_corr_revenue_vs_seasonality_index"))


def seasonality_buckets(revenue: DataFrame, factors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(bucket, avg_revenue, num_days, min_revenue, max_revenue), low to high.

    index < 0.9 low, < 1.1 mid, otherwise (NULL included) high.
    """
    j = _revenue_factors(revenue, factors, keys, ["seasonality_index"])
    s = F.col("seasonality_index")
    bucket = (F.when(s < LOW_BOUND, F.lit(BUCKETS[0])).when(s < HIGH_BOUND, F.lit(BUCKETS[1]))
              .otherwise(F.lit(BUCKETS[2])))
    ordinal = F.when(s < LOW_BOUND, 1).when(s < HIGH_BOUND, 2).otherwise(3)
    return (j.groupBy(*keys, bucket.alias("bucket"), ordinal.alias("_ord"))
            .agg(average(j, "revenue").alias("avg_revenue"), F.count(F.lit(1)).alias("num_days"),
                 F.min("revenue").alias("min_revenue"), F.max("revenue").alias("max_revenue"))
            .orderBy(*keys, "_ord").drop("_ord"))
