"""Sums of doubles that do not depend on the order of addition.

A double is cut into six 30-bit pieces, from 2^90 down to 2^-90, which add up as integers in any order and any
partitioning; what the pieces add up to is rounded to a double once, at the end. Equal totals are then equal doubles,
and totals that differ by more than their last bit stay apart, so ranks need no tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMB_BITS = 30
TOP_BITS = 90
_LIMBS = 6
_MASK = (1 << LIMB_BITS) - 1
_BASE = 1 << LIMB_BITS

# Everything is one SQL text: as nested Column calls it takes a tenth of a second to build.


def _limb(x: str, i: int) -> str:
    """Signed piece i of x, the highest first; a double's remainder by a power of two is exact."""
    weight = 2.0 ** (TOP_BITS - LIMB_BITS * (i + 1))
    size = f"ABS({x})" if i == 0 else f"ABS({x}) % {weight * _BASE!r}D"
    return f"CASE WHEN {x} < 0 THEN -FLOOR({size} / {weight!r}D) ELSE FLOOR({size} / {weight!r}D) END"


def _units(parts: list[str]) -> str:
    """The pieces, highest first, as one whole number in units of the lowest."""
    total = f"CAST({parts[0]} AS DECIMAL(38,0))"
    for p in parts[1:]:
        total = f"CAST({total} * {_BASE} + {p} AS DECIMAL(38,0))"
    return total


def _rounded(sums: list[str]) -> str:
    """The double nearest to the number that the summed pieces stand for."""
    carried = list(sums)
    for i in range(_LIMBS - 1, 2, -1):
        carried[i - 1] = f"({carried[i - 1]} + SHIFTRIGHT({carried[i]}, {LIMB_BITS}))"
    low = [f"({c} & {_MASK}L)" for c in carried[3:]]
    whole = _units(carried[:3])
    size = f"ABS(CAST({whole} AS DOUBLE))"
    return (f"CASE WHEN {size} < {float(_BASE)!r}D THEN CAST({_units([*carried[:3], *low])} AS DOUBLE) / {float(_BASE) ** 3!r}D "
            f"WHEN {size} < {float(_BASE) ** 2!r}D THEN CAST({_units([*carried[:3], *low[:2]])} AS DOUBLE) / {float(_BASE) ** 2!r}D "
            f"ELSE CAST({whole} AS DOUBLE) END")


def exact_sum(x: str) -> Column:
    """SUM of a DOUBLE (a column or an SQL expression) as one aggregate column, the same for every order and partitioning
    of the rows.

    NULLs are skipped; no values give NULL. Bits below 2^-90 are cut (below 2^-60 for a total beyond 2^30). If a value is
    NaN, infinite or 2^90 (about 1.2e27) or more, the result is the plain sum. More than 2^33 values in a group can end
    in an overflow error, never in a wrong sum.
    """
    x = f"({x})"
    fits = f"({x} IS NULL OR (ABS({x}) < {2.0 ** TOP_BITS!r}D AND NOT ISNAN({x})))"
    pieces = [f"SUM(CASE WHEN {fits} THEN {_limb(x, i)} END)" for i in range(_LIMBS)]
    return F.expr(f"CASE WHEN BOOL_AND({fits}) THEN {_rounded(pieces)} ELSE SUM({x}) END")


def exact_mean(x: str) -> Column:
    """AVG of a DOUBLE as its exact sum over the count; NULL for no values."""
    return F.try_divide(exact_sum(x), F.count(F.expr(x)).cast("double"))


def is_double(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def total(df: DataFrame, name: str, x: str | None = None) -> Column:
    """SUM of column ``name`` (or of the SQL expression ``x`` of it): DECIMAL and integer sums are exact as they are."""
    x = f"`{name}`" if x is None else x
    return exact_sum(f"CAST({x} AS DOUBLE)") if is_double(df, name) else F.sum(F.expr(x))


def average(df: DataFrame, name: str, x: str | None = None) -> Column:
    """AVG in DOUBLE of column ``name`` (or of the SQL expression ``x`` of it) by its exact sum."""
    values = F.expr(f"`{name}`" if x is None else x)
    return F.try_divide(total(df, name, x).cast("double"), F.count(values).cast("double"))
