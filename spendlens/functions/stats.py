"""Aggregate expressions for the statistics the operators report.

Moments of DECIMAL and integer columns are sums of integers: a value is taken in units of its last digit, and the sums
of x, x^2 and xy are DECIMAL(38, 0), so that they merge exactly in any order. The centred moments are made of them
without loss (about an integer near the mean), and rounded to a double once. A DOUBLE is first rounded to
``DOUBLE_DIGITS`` digits after the point. Where these sums could leave 38 digits, or a DOUBLE is too small for its digits,
the statistics are Spark's own, whose last bits depend on how partitions merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE_DIGITS = 12
#: Squares sum up exactly while (largest value in units)^2 * rows stays below this; half a digit less than DECIMAL(38).
MOST_SQUARES = 1e37
#: A value in units must fit DECIMAL(19, 0), so that a product fits 38 digits, and a BIGINT, as a mean does.
MOST_UNITS = 9e18
#: A DOUBLE column whose largest value is below this keeps too few of its digits in units.
LEAST_DOUBLE = 1e-3
_UNITS, _SUM = "decimal(19,0)", "decimal(38,0)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digits_of(df: DataFrame, name: str) -> int | None:
    """Digits after the point of a column's values; None for DOUBLE."""
    kind = df.schema[name].dataType
    return kind.scale if isinstance(kind, T.DecimalType) else 0 if isinstance(kind, T.IntegralType) else None


def _units(x: Column, digits: int | None) -> Column:
    """x in units of its last digit; NULL beyond DECIMAL(19, 0)."""
    scale = DOUBLE_DIGITS if digits is None else digits
    return (x.try_cast(f"decimal(38,{scale})") * F.lit(10 ** scale).cast("decimal(13,0)")).try_cast(_UNITS)


class _Sums:
    """Sums of one or two columns in units, and whether they are exact."""

    def __init__(self, *columns: tuple[Column, int | None]):
        self.units = [_units(x, digits) for x, digits in columns]
        self.scale = [10.0 ** (DOUBLE_DIGITS if d is None else d) for _, d in columns]
        self.n = F.count(columns[0][0])
        self.sums = [F.try_sum(u) for u in self.units]
        self.means = [self._floor_mean(s) for s in self.sums]
        largest = [F.max(F.abs(x.cast("double"))) for x, _ in columns]
        in_units = [m * F.lit(s) for m, s in zip(largest, self.scale)]
        widest = F.greatest(*in_units) if len(in_units) > 1 else in_units[0]
        self.fits = (widest < F.lit(MOST_UNITS)) & (widest * widest * self.n.cast("double") < F.lit(MOST_SQUARES))
        for m, (_, digits) in zip(largest, columns):
            if digits is None:
                self.fits = self.fits & (m >= F.lit(LEAST_DOUBLE))

    def _floor_mean(self, total: Column) -> Column:
        return F.floor(F.try_divide(total, self.n.cast(_UNITS))).try_cast(_UNITS)

    def centred(self, i: int, j: int) -> Column:
        """Sum of (x - a)(y - b) about integers a and b near the means, less what they are off: exact, in units^2."""
        x, y, a, b = self.sums[i], self.sums[j], self.means[i], self.means[j]
        n = self.n.cast(_UNITS)
        products = F.try_sum((self.units[i] * self.units[j]).try_cast(_SUM))
        about = _minus(_minus(products, _times(a, y)), _times(b, _minus(x, _times(n, a))))
        off = _minus(x, _times(n, a)).cast("double") * _minus(y, _times(n, b)).cast("double") / self.n.cast("double")
        return about.cast("double") - off


def _times(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b).try_cast(_SUM)


def _minus(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b).try_cast(_SUM)


def population_stddev(x, digits: int | None = None) -> Column:
    """Population standard deviation (never negative) of a column with ``digits`` after the point (None: DOUBLE)."""
    x = _c(x)
    own = _Sums((x, digits))
    variance = F.greatest(own.centred(0, 0), F.lit(0.0)) / own.n.cast("double")
    exact = F.sqrt(variance) / F.lit(own.scale[0])
    return F.when(own.n > 0, F.when(own.fits, exact).otherwise(F.stddev_pop(x.cast("double"))))


def pearson(x, y, x_digits: int | None = None, y_digits: int | None = None) -> Column:
    """Pearson r of complete (x, y) pairs; NULL when either side has zero variance.

    ``corr`` raises on zero variance under ANSI mode, and a CASE around it does not help because the aggregate is
    evaluated first. Zero variance is detected exactly with min = max instead of a floating-point test.
    """
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    own = _Sums((x, x_digits), (y, y_digits))
    exact = F.try_divide(own.centred(0, 1), F.sqrt(own.centred(0, 0)) * F.sqrt(own.centred(1, 1)))
    xx, yy = x.cast("double"), y.cast("double")
    plain = F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
    flat = (F.min(xx) == F.max(xx)) | (F.min(yy) == F.max(yy))
    return F.when(flat, F.lit(None).cast("double")).when(own.fits, exact).otherwise(plain)
