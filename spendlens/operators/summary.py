"""Exploratory summaries: channel spend (A08), revenue (A09), monthly totals (A10),
day-of-week pattern (A11), calendar-month seasonality (A12).

Inputs are the deduplicated feeds. Means are exact sums over counts, divided in DOUBLE; the
reference rounds some means to 2 digits, kept as the ``digits`` default.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.columns import row_total, weekday_abbrev, year_month
from spendlens.functions.exact import average, total
from spendlens.functions.joins import join_on
from spendlens.sources.schemas import spend_columns


def channel_summary(spend_long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per channel: days, total, mean, min, max spend; largest total first."""
    return (spend_long.groupBy(*keys, "channel").agg(
        F.count(F.lit(1)).alias("days_count"),
        total(spend_long, "spend").alias("total_spend"),
        average(spend_long, "spend").alias("avg_spend_per_day"),
        F.min("spend").alias("min_spend"),
        F.max("spend").alias("max_spend"),
    ).orderBy(*keys, F.col("total_spend").desc(), "channel"))


def revenue_summary(revenue: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per key) of day count, revenue, transaction and new-customer totals and means."""
    g = revenue.groupBy(*keys) if keys else revenue.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("days_count"),
        total(revenue, "revenue").alias("total_revenue"),
        average(revenue, "revenue").alias("avg_revenue_per_day"),
        F.min("revenue").alias("min_revenue"),
        F.max("revenue").alias("max_revenue"),
        F.sum("transactions").alias("total_transactions"),
        average(revenue, "transactions").alias("avg_transactions_per_day"),
        F.sum("new_customers").alias("total_new_customers"),
        average(revenue, "new_customers").alias("avg_new_customers_per_day"),
    )


def _daily_totals(spend_wide: DataFrame, revenue: DataFrame, keys: Sequence[str],
                  value_cols: Sequence[str] | None) -> DataFrame:
    """Revenue days joined with the day's total spend (NULL if any channel is NULL)."""
    spend_total = spend_wide.select(*keys, "date", row_total(value_cols or spend_columns()).alias("total_spend"))
    return join_on(revenue.select(*keys, "date", "revenue"), spend_total, keys)


def monthly_totals(spend_wide: DataFrame, revenue: DataFrame, keys: Sequence[str] = (),
                   digits: int = 2, value_cols: Sequence[str] | None = None) -> DataFrame:
    """(year_month, total_spend, total_revenue) over the dates present in both feeds."""
    j = _daily_totals(spend_wide, revenue, keys, value_cols)
    return (j.groupBy(*keys, year_month("date").alias("year_month"))
            .agg(F.round(total(j, "total_spend"), digits).alias("total_spend"),
                 F.round(total(j, "revenue"), digits).alias("total_revenue"))
            .orderBy(*keys, "year_month"))


def dow_pattern(spend_wide: DataFrame, revenue: DataFrame, keys: Sequence[str] = (),
                digits: int = 2, value_cols: Sequence[str] | None = None) -> DataFrame:
    """Mean total spend and revenue by weekday (Sun..Sat labels), Monday first."""
    j = _daily_totals(spend_wide, revenue, keys, value_cols)
    return (j.groupBy(*keys, F.weekday("date").alias("_wd"), weekday_abbrev("date").alias("dow"))
            .agg(F.round(average(j, "total_spend"), digits).alias("avg_tot_spend"),
                 F.round(average(j, "revenue"), digits).alias("avg_tot_revenue"))
            .orderBy(*keys, "_wd").drop("_wd"))


def month_seasonality(spend_wide: DataFrame, revenue: DataFrame, factors: DataFrame, keys: Sequence[str] = (),
                      digits: int = 2, index_digits: int = 3,
                      value_cols: Sequence[str] | None = None) -> DataFrame:
    """Mean spend, revenue and seasonality index per calendar month across years."""
    j = join_on(_daily_totals(spend_wide, revenue, keys, value_cols),
                factors.select(*keys, "date", "seasonality_index"), keys)
    return (j.groupBy(*keys, F.month("date").alias("month_num"))
            .agg(F.round(average(j, "total_spend"), digits).alias("avg_tot_spend"),
                 F.round(average(j, "revenue"), digits).alias("avg_tot_revenue"),
                 F.round(average(j, "seasonality_index"), index_digits).alias("avg_seasonality_index"))
            .orderBy(*keys, "month_num"))
