"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded_ratio(num, den) -> Column:
    """num / den in DOUBLE when den > 0, else NULL (zero or NULL denominator)."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def share_or_zero(num, den) -> Column:
    """num / den in DOUBLE when den > 0, else 0.0 (the attribution guard)."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def row_total(cols: Iterable[str]) -> Column:
    """Sum across columns of one row; NULL if any input is NULL."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


def year_month(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def year_quarter(d) -> Column:
    d = _c(d)
    return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))


def weekday_abbrev(d) -> Column:
    return F.date_format(_c(d), "EEE")


def cents(x) -> Column:
    """Money as exact integer cents (BIGINT), rounding half up.

    A DOUBLE is scaled and rounded natively (no per-row BigDecimal, which costs more
    than the scan itself); for amounts with at most 2 decimals this equals the cast to
    DECIMAL(18,2). Sums of cents are exact, fast long additions; ANSI mode raises on
    overflow rather than wrapping.
    """
    x = _c(x)
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def from_cents(x, precision: int = 18) -> Column:
    """Integer cents back to DECIMAL(precision, 2), exactly."""
    return (_c(x).cast("decimal(38,0)") / F.lit(100)).cast(f"decimal({precision},2)")
