"""Run every report of the reference scripts over one set of prepared feeds and export them.

The prepared feeds are materialized once (lineage cut into the checkpoint folder) because
all reports read them; each report is then a small job over daily rows, per entity if the feeds have keys.
"""

from __future__ import annotations

import os
from typing import Callable

from pyspark.sql import DataFrame

from spendlens import operators as ops
from spendlens.plans.prepared import Prepared, materialize
from spendlens.session import cut
from spendlens.sources.feeds import INGEST_ORD, write_published, write_result


FEEDS = {"spend": "marketing_spend", "revenue": "revenue", "factors": "external_factors"}


def counted_feeds(p: Prepared) -> dict[str, DataFrame]:
    """The raw feeds as distinct rows with their number: one pass over each."""
    raw = p.raw or p
    return {n: ops.counted_rows(getattr(raw, n).drop(INGEST_ORD)) for n in FEEDS if hasattr(raw, n)}


def reports(p: Prepared, raw: dict[str, DataFrame] | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Report name -> builder, in the order the reference runs them.

    ``raw`` holds the counted feeds that the data-quality reports read (default: made of the raw feeds, in each report).
    """
    k = list(p.keys)
    raw = counted_feeds(p) if raw is None else raw
    past = getattr(p, "history", None)
    fact30 = lambda: ops.attributed_fact(p.spend, p.revenue, (30,), keys=k, history=past)
    return {
        # data quality looks at the rows as they arrived
        "null_profile": lambda: ops.null_profile({FEEDS[n]: df for n, df in raw.items()}),
        "date_gaps": lambda: ops.date_gaps(raw["spend"], keys=k),
        "revenue_outliers": lambda: ops.outliers(raw["revenue"], "revenue", keys=k),
        "spend_outliers": lambda: ops.spend_outliers(raw["spend"], keys=k),
        **{f"duplicate_dates_{n}": (lambda df=df: ops.duplicate_keys(df, [*k, "date"]).orderBy(*k, "date"))
           for n, df in raw.items()},
        "channel_summary": lambda: ops.channel_summary(p.spend_long, keys=k),
        "revenue_summary": lambda: ops.revenue_summary(p.revenue, keys=k),
        "monthly_totals": lambda: ops.monthly_totals(p.spend, p.revenue, keys=k),
        "dow_pattern": lambda: ops.dow_pattern(p.spend, p.revenue, keys=k),
        "month_seasonality": lambda: ops.month_seasonality(p.spend, p.revenue, p.factors, keys=k),
        "same_day_attribution": lambda: ops.same_day_attribution(p.spend, p.revenue, keys=k),
        "attribution_30": lambda: ops.rolling_attribution(p.spend, p.revenue, 30, keys=k, history=past),
        "attribution_windows": lambda: ops.attribution_windows(p.spend, p.revenue, keys=k, history=past),
        "top_bottom": lambda: ops.top_bottom(fact30(), keys=k),
        "perf_by_month": lambda: ops.perf_by_month(fact30(), keys=k),
        "perf_weekend": lambda: ops.perf_by_day_type(fact30(), p.factors, keys=k),
        "perf_promo": lambda: ops.perf_by_promo(fact30(), p.factors, keys=k),
        "corr_spend_revenue": lambda: ops.corr_spend_revenue(p.spend, p.revenue, keys=k),
        "revenue_lift": lambda: ops.revenue_lift(p.revenue, p.factors, keys=k),
        "corr_seasonality": lambda: ops.corr_revenue_seasonality(p.revenue, p.factors, keys=k),
        "seasonality_buckets": lambda: ops.seasonality_buckets(p.revenue, p.factors, keys=k),
        "incrementality": lambda: ops.incrementality(p.spend, p.revenue, keys=k),
        "return_by_quartile": lambda: ops.return_by_quartile(p.spend, p.revenue, keys=k),
        "cohort_quarter": lambda: ops.cohort_by_quarter(fact30(), keys=k),
        "spend_consistency": lambda: ops.spend_consistency(p.spend_long, keys=k),
        "efficiency_curve": lambda: ops.efficiency_curve(p.spend, p.revenue, keys=k),
        "budget_reallocation": lambda: ops.budget_reallocation(p.spend, p.revenue, keys=k, history=past),
    }


QUALITY = ("null_profile", "date_gaps", "revenue_outliers", "spend_outliers", "duplicate_dates_spend",
           "duplicate_dates_revenue", "duplicate_dates_factors")

# The file names under which results are published.
PUBLISHED = {
    "attribution_windows": "Attribution_windows.csv",
    "budget_reallocation": "Budget_reallocation.csv",
    "perf_by_month": "Channel_perf_by_month.csv",
    "perf_promo": "Channel_perf_promo_no_promo.csv",
    "perf_weekend": "Channel_perf_weekend_no_weekend.csv",
    "cohort_quarter": "Cohort_analysis.csv",
    "corr_spend_revenue": "Corr_spend_revenue.csv",
    "efficiency_curve": "Efficiency_curves.csv",
    "incrementality": "Incrementality.csv",
    "return_by_quartile": "Return_by_quartile.csv",
    "revenue_lift": "Revenue_lift.csv",
    "seasonality_buckets": "Seasonality.csv",
    "spend_consistency": "Spend_consistency.csv",
    "top_bottom": "Top_bottom_channel.csv",
    "same_day_attribution": "Total_spend_total_revenue_by_channel.csv",
}


def export_reports(p: Prepared, out_dir: str, fmt: str = "csv", names=None, cut_lineage: bool = True) -> list[str]:
    """Write each report under ``out_dir`` (replace if exists); returns the names written.

    Reports are per-channel or per-period summaries (tens to hundreds of rows). As ``csv`` each becomes one file in the
    published form, under its published name if it has one; another ``fmt`` makes a folder ``<name>`` with a single part.
    Each raw feed is read once for all data-quality reports, and once more by the deduplication.
    """
    src = materialize(p) if cut_lineage else p
    wanted_raw = cut_lineage and (names is None or set(names) & set(QUALITY))
    raw = {n: cut(df) for n, df in counted_feeds(src).items()} if wanted_raw else None
    written = []
    for name, build in reports(src, raw).items():
        if names and name not in names:
            continue
        if fmt == "csv":
            write_published(build(), os.path.join(out_dir, PUBLISHED.get(name, f"{name}.csv")))
        else:
            write_result(build(), os.path.join(out_dir, name), fmt=fmt, single_file=True)
        written.append(name)
    return written
