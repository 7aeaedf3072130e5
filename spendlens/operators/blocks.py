"""Trailing windows in blocks of dates: an entity's series of any length is rolled by many tasks.

A block holds the rows of so many consecutive steps, and before them a halo: copies of the rows that the trailing
windows of its first rows reach back to. A window per block then gives what one window over the whole series gives, and
the halo's own results are left out. Rows that only serve as context, such as those before the first date of a report,
are marked as halo from the start.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.joins import join_on

HALO, BLOCK = "_halo", "_block"


def step_of(df: DataFrame, date_col: str = "date") -> Column:
    """The date column as a whole number of days, microseconds or, for integers, steps."""
    kind, x = df.schema[date_col].dataType, F.col(date_col)
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_timestamp_ltz(x))
    if isinstance(kind, T.IntegralType):
        return x.cast("long")
    raise TypeError(f"no blocks over {kind.simpleString()}")


def with_history(df: DataFrame, history: DataFrame | None) -> DataFrame:
    """``df`` with ``_halo`` false, and the rows of ``history`` (same columns) with ``_halo`` true."""
    own = df.withColumn(HALO, F.lit(False))
    return own if history is None else own.unionByName(history.select(*df.columns).withColumn(HALO, F.lit(True)))


def in_blocks(df: DataFrame, series: Sequence[str], steps: int, k: int, days: bool = False) -> DataFrame:
    """``df`` (with ``_halo``) in blocks of ``steps`` steps of its date, with halos for windows of ``k`` rows.

    Adds ``_block``; a halo row stands in a block before the rows of its own. ``series`` are the columns of a series,
    in which a date should not repeat; so a block holds ``steps`` rows of it and k - 1 of its halo at most. With
    ``days``, windows reach k - 1 steps back instead of k - 1 rows. Rows without a date stand in a block of their own,
    before all others.
    """
    series, reach = list(series), k - 1
    step = step_of(df)
    own = df.withColumn(BLOCK, F.floor(step / F.lit(steps)).cast("long"))
    if reach < 1:
        return own
    if days:
        last = F.floor((step + reach) / F.lit(steps)).cast("long")
        copies = own.where(last > F.col(BLOCK)) \
            .withColumn(BLOCK, F.explode(F.sequence(F.col(BLOCK) + 1, last)))
        return own.unionByName(copies.withColumn(HALO, F.lit(True)))

    # rows of the blocks that follow, up to the one that k - 1 rows reach: at most k - 1 blocks, as none is empty
    ordered = Window.partitionBy(*series).orderBy(F.col(BLOCK).asc_nulls_first())
    sizes = own.groupBy(*series, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    ends = sizes.withColumn("_end", F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    follow = ends.withColumn("_next", F.collect_list(F.struct(F.col(BLOCK), (F.col("_end") - F.col("_n")).alias("first")))
                             .over(ordered.rowsBetween(1, reach))).select(*series, BLOCK, "_end", "_next")
    from_end = F.row_number().over(Window.partitionBy(*series, BLOCK).orderBy(F.col("date").desc_nulls_last()))
    tails = own.withColumn("_from_end", from_end).where(F.col("_from_end") <= reach)
    reached = join_on(tails, follow, [*series, BLOCK], on=()).withColumn(
        "_to", F.explode(F.filter("_next", lambda b: b["first"] - F.col("_end") + F.col("_from_end") <= reach)))
    copies = reached.withColumn(BLOCK, F.col(f"_to.{BLOCK}")).withColumn(HALO, F.lit(True)).select(*own.columns)
    return own.unionByName(copies)
