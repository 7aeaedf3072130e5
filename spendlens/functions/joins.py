"""Joins on entity keys, where NULL is an entity like any other."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), on: Sequence[str] = ("date",),
            how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``: the columns of ``left``, then those of ``right`` that are not joined on.

    Rows meet where all ``on`` columns are equal (a NULL date meets nothing) and all ``keys`` are equal or both NULL.
    """
    keys, on = list(keys), list(on)
    if not keys:
        return left.join(right, on, how)
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in [*keys, *on]})
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys] + [F.col(c) == F.col(f"_other_{c}") for c in on]
    return left.join(other, reduce(lambda a, b: a & b, same), how).drop(*[f"_other_{c}" for c in [*keys, *on]])
