"""Analytics operators (DataFrame in, DataFrame out)."""

from spendlens.operators.attribution import (attributed_fact, attribution_windows, rolling_attribution,
                                             same_day_attribution)
from spendlens.operators.bins import bin_ends, lowest_end, segments
from spendlens.operators.blocks import in_blocks
from spendlens.operators.breakdown import (cohort_by_quarter, perf_by_day_type, perf_by_month, perf_by_promo,
                                           top_bottom)
from spendlens.operators.budget import budget_reallocation, channel_roas_summary, spend_consistency
from spendlens.operators.curves import efficiency_curve, incrementality, return_by_quartile
from spendlens.operators.drivers import (corr_revenue_seasonality, corr_spend_revenue, revenue_lift,
                                         seasonality_buckets)
from spendlens.operators.quality import (counted_rows, date_gaps, duplicate_keys, null_profile, outliers, repeated,
                                         spend_outliers)
from spendlens.operators.ranking import (equal_count_bin, in_lowest_fraction, mark_ranks, nth_value, rank_bounds,
                                         rank_within)
from spendlens.operators.shape import densify, keep_first, unpivot_channels
from spendlens.operators.summary import (channel_summary, dow_pattern, month_seasonality, monthly_totals,
                                         revenue_summary)

__all__ = [
    "null_profile", "date_gaps", "outliers", "spend_outliers", "duplicate_keys", "counted_rows", "repeated",
    "keep_first", "unpivot_channels", "densify",
    "channel_summary", "revenue_summary", "monthly_totals", "dow_pattern", "month_seasonality",
    "attributed_fact", "same_day_attribution", "rolling_attribution", "attribution_windows",
    "top_bottom", "perf_by_month", "perf_by_day_type", "perf_by_promo", "cohort_by_quarter",
    "corr_spend_revenue", "revenue_lift", "corr_revenue_seasonality", "seasonality_buckets",
    "rank_within", "equal_count_bin", "in_lowest_fraction", "mark_ranks", "nth_value", "rank_bounds",
    "segments", "bin_ends", "lowest_end", "in_blocks",
    "incrementality", "return_by_quartile", "efficiency_curve",
    "spend_consistency", "channel_roas_summary", "budget_reallocation",
]
