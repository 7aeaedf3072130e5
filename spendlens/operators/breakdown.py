"""Breakdowns of the 30-row attributed fact: top/bottom channels (A16), by month (A17),
weekend vs weekday (A18), promotion vs none (A19), by calendar quarter (A26)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.columns import guarded_ratio, year_month, year_quarter
from spendlens.functions.exact import total
from spendlens.functions.joins import join_on
from spendlens.functions.shared import shared
from spendlens.operators.ranking import with_facts

# Report labels (top/bottom metrics; weekend flag yes/no; promotion flag yes/no).
METRICS = ("top_revenue", "bottom_revenue", "top_roas", "bottom_roas")
DAY_TYPES = ("weekend", "weekday")
PROMO_FLAGS = ("promo", "non_promo")


def _totals(fact: DataFrame, group: Sequence, rev_name: str, roas_name: str) -> DataFrame:
    return (fact.groupBy(*group)
            .agg(total(fact, "spend").alias("total_spend"), total(fact, "attributed_revenue").alias(rev_name))
            .withColumn(roas_name, guarded_ratio(rev_name, "total_spend")))


def top_bottom(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Labelled rows (metric, channel, value): top/bottom by attributed revenue and ROAS.

    RANK semantics: ties give several rows; "bottom" is the largest rank, and NULLs rank last. Totals are exact sums,
    so they are ranked as they are. The first and the last rank are those of the largest and the smallest value per
    key, one aggregate that merges; no window or task holds all channels.
    """
    agg = shared(_totals(fact, [*keys, "channel"], "total_revenue_attributed_30", "roas_30"), "channel")
    rev, roas = F.col("total_revenue_attributed_30"), F.col("roas_30")

    def least(x):  # that of the largest rank: NULL, if there is one
        return F.when(F.count(x) == F.count(F.lit(1)), F.min(x))

    bounds = (agg.groupBy(*keys) if keys else agg.groupBy()).agg(
        F.max(rev).alias("_rev_top"), least(rev).alias("_rev_bottom"),
        F.max(roas).alias("_roas_top"), least(roas).alias("_roas_bottom"))
    ranked = with_facts(agg, bounds, keys)

    def row(metric, value, bound):
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"), value.eqNullSafe(F.col(bound)).alias("_keep"))

    top_rev, bottom_rev, top_roas, bottom_roas = METRICS
    rows = F.array(row(top_rev, rev, "_rev_top"), row(bottom_rev, rev, "_rev_bottom"),
                   row(top_roas, roas, "_roas_top"), row(bottom_roas, roas, "_roas_bottom"))
    return (ranked.select(*keys, "channel", F.inline(rows)).where("_keep")
            .select(*keys, "metric", "channel", "value").orderBy(*keys, "metric", "channel"))


def perf_by_month(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(period_month, period_quarter, channel, total_spend, total_revenue_attr_30, roas_30)."""
    labelled = fact.select("*", year_month("date").alias("period_month"),
                           year_quarter("date").alias("period_quarter"))
    return (_totals(labelled, [*keys, "period_month", "period_quarter", "channel"], "total_revenue_attr_30", "roas_30")
            .orderBy(*keys, "period_month", F.col("roas_30").desc(), "channel"))


def _flag_breakdown(fact: DataFrame, factors: DataFrame, flag: str, label: str, yes: str, no: str,
                    keys: Sequence[str]) -> DataFrame:
    # A NULL flag falls in the "no" arm, as the reference's CASE does.
    j = join_on(fact, factors.select(*keys, "date", flag), keys)
    labelled = j.withColumn(label, F.when(F.col(flag) == 1, F.lit(yes)).otherwise(F.lit(no)))
    return (_totals(labelled, [*keys, label, "channel"], "total_revenue_attr_30", "roas_30")
            .orderBy(*keys, label, F.col("roas_30").desc(), "channel"))


def perf_by_day_type(fact: DataFrame, factors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(day_type weekend|weekday, channel, total_spend, total_revenue_attr_30, roas_30)."""
    return _flag_breakdown(fact, factors, "is_weekend", "day_type", *DAY_TYPES, keys)


def perf_by_promo(fact: DataFrame, factors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(promo_flag promo|non_promo, channel, total_spend, total_revenue_attr_30, roas_30)."""
    return _flag_breakdown(fact, factors, "promotion_active", "promo_flag", *PROMO_FLAGS, keys)


def cohort_by_quarter(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(channel, period_quarter 'YYYY-Qn', total_spend, total_attr_rev_30, roas_30)."""
    labelled = fact.withColumn("period_quarter", year_quarter("date"))
    return (_totals(labelled, [*keys, "channel", "period_quarter"], "total_attr_rev_30", "roas_30")
            .orderBy(*keys, "period_quarter", "channel"))
