"""Tables that several branches of one plan read, and that are to be made once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(df: DataFrame) -> DataFrame:
    """``df`` as rows of a generator, which no later column pruning or filter reaches through.

    Several branches over it then hold the same subplan, down to the scan, and Spark runs its shuffle once and reuses it,
    where it would otherwise read a table again for every other choice of columns.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def shared(df: DataFrame, *by: str) -> DataFrame:
    """A small ``df`` that branches read from one shuffle of it (by columns ``by``), with nothing left to compute."""
    return whole(df.repartition(*by))
