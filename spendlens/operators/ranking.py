"""Row numbers per group and equal-count bins over daily rows, and first and last ranks without a window over a group.

The ranked facts hold one row per (entity, channel, date), so a window partition is bounded by the calendar, as those
of the trailing sums are. The rows that hold the first or last ranks of any number of channels are found by the values
that bound them: every task offers its n smallest and n largest, and rows are then compared with the bounds, so that no
task sees more than n values of each other one. Nothing runs before an action.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.joins import join_on


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], rn_col: str = "rn",
                n_col: str = "n") -> DataFrame:
    """Add ``rn_col`` (1-based row number in the group by ``order_cols``) and ``n_col`` (group size).

    ``order_cols`` should make the order total within a group (e.g. spend, then date); NULLs sort first, as in the
    reference engine.
    """
    group = Window.partitionBy(*group_cols)
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    return df.withColumn(rn_col, F.row_number().over(group.orderBy(*order))) \
        .withColumn(n_col, F.count(F.lit(1)).over(group))


def equal_count_bin(rn: str, n: str, bins: int) -> Column:
    """Bin of a 1-based row number: (rn - 1) * bins div n + 1, in integers.

    Sizes follow the floor rule (not NTILE): 728 rows in 10 bins give
    73,73,73,73,72,73,73,73,73,72.
    """
    return F.expr(f"((CAST({rn} AS BIGINT) - 1) * {int(bins)}) div {n} + 1").cast("bigint")


def in_lowest_fraction(rn: Column | str, n: Column | str, parts: int = 10) -> Column:
    """rn <= n / parts, in integers (rn * parts <= n)."""
    rn = F.col(rn) if isinstance(rn, str) else rn
    n = F.col(n) if isinstance(n, str) else n
    return rn * F.lit(int(parts)) <= n


def with_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns of ``facts``, which has one row per key (one row, if there are no keys)."""
    if keys:
        return join_on(df, facts, keys, on=())
    # one mention of the subquery: each would be planned on its own
    row = df.withColumn("_facts", facts.select(F.struct(*facts.columns)).scalar())
    return row.select(*df.columns, *[F.col("_facts").getField(c).alias(c) for c in facts.columns])


def nth_value(df: DataFrame, value: str, n: int, out: str, keys: Sequence[str] = (), largest: bool = False) -> DataFrame:
    """(keys, out): the n-th smallest (or largest) of the values per key, repeats counted; the last one if there are
    fewer. NULLs are no values.
    """
    order = F.col(value).desc() if largest else F.col(value).asc()
    last = (F.min if largest else F.max)(value).alias(out)
    values = df.select(*keys, value).where(F.col(value).isNotNull())
    if not keys:
        return values.orderBy(order).limit(n).agg(last)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return values.withColumn("_place", place).where(F.col("_place") <= n).groupBy(*keys).agg(last)


def rank_bounds(df: DataFrame, value: str, n_low: int, n_high: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _low, _high): RANK() of a value per key is n_low or less ascending where it is at most ``_low``, and n_high
    or less descending where it is at least ``_high``; so all that tie with the n-th one belong.
    """
    return with_facts(nth_value(df, value, n_low, "_low", keys), nth_value(df, value, n_high, "_high", keys, largest=True),
                      keys)


def mark_ranks(df: DataFrame, value: str, n_low: int, n_high: int, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``_is_low`` and ``_is_high``: whether a row's rank is within ``rank_bounds``; a NULL value has no rank."""
    marked = with_facts(df, rank_bounds(df, value, n_low, n_high, keys), keys)
    return marked.select(*df.columns, F.coalesce(F.col(value) <= F.col("_low"), F.lit(False)).alias("_is_low"),
                         F.coalesce(F.col(value) >= F.col("_high"), F.lit(False)).alias("_is_high"))
