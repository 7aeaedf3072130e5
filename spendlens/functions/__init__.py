from spendlens.functions.columns import (guarded_ratio, row_total, share_or_zero,
                                         weekday_abbrev, year_month, year_quarter)
from spendlens.functions.exact import exact_mean, exact_sum
from spendlens.functions.joins import join_on
from spendlens.functions.stats import pearson, population_stddev

__all__ = ["guarded_ratio", "share_or_zero", "row_total", "year_month",
           "year_quarter", "weekday_abbrev", "exact_sum", "exact_mean", "join_on", "pearson", "population_stddev"]
