"""Prepared feeds as tables: written partitioned by month, read back with date filters that
prune month folders and push down to the parquet scan.

A report over a range of dates needs, for its trailing windows, the rows before the first date. A small
calendar (rows per entity and month) tells which months hold the last of these rows for every
entity, so a range is read with as much history as its windows reach back to, and no more.
"""

from __future__ import annotations

import datetime as dt
import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.plans.prepared import Prepared

_TABLES = ("spend", "revenue", "factors")
_CALENDAR = "spend_calendar"
MONTH = "year_month"


def save_prepared(p: Prepared, root: str, mode: str = "overwrite") -> None:
    """Write the tables that ``p`` has, and the calendar of its spend."""
    for name in _TABLES:
        if hasattr(p, name):
            (getattr(p, name).withColumn(MONTH, F.date_format("date", "yyyy-MM"))
             .repartition(MONTH).write.mode(mode).partitionBy(MONTH).parquet(os.path.join(root, name)))
    months = p.spend.sparkSession.read.parquet(os.path.join(root, "spend"))
    months.groupBy(*p.keys, F.col(MONTH).cast("string").alias(MONTH)).agg(F.count(F.lit(1)).alias("n")) \
        .write.mode(mode).parquet(os.path.join(root, _CALENDAR))


def _months(spark: SparkSession, root: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(root, name))
    return df.withColumn(MONTH, F.col(MONTH).cast("string"))


def _first_month(start: dt.date | str) -> str:
    return str(start)[:7]


def history_months(spark: SparkSession, root: str, start: dt.date | str, rows: int, keys: Sequence[str] = ()) -> list[str]:
    """The months up to that of ``start`` in which some entity has one of its last ``rows`` rows before ``start``.

    Months are counted whole, so that of ``start`` is always among them, and an entity that rests for years adds the
    months in which it was last active and no others. One row per calendar month comes back at most.
    """
    calendar = spark.read.parquet(os.path.join(root, _CALENDAR)).where(F.col(MONTH) < _first_month(start))
    later = Window.partitionBy(*keys).orderBy(F.col(MONTH).desc()).rowsBetween(Window.unboundedPreceding, -1)
    needed = calendar.withColumn("_later", F.coalesce(F.sum("n").over(later), F.lit(0))).where(F.col("_later") < rows)
    return sorted({r[MONTH] for r in needed.select(MONTH).distinct().collect()} | {_first_month(start)})


def load_prepared(spark: SparkSession, root: str, start: dt.date | str | None = None,
                  end: dt.date | str | None = None, keys: Sequence[str] = (), lookback: int = 30) -> Prepared:
    """Read prepared tables; ``start``/``end`` (inclusive) prune month partitions and rows.

    With a ``start``, ``history`` of the result holds the last ``lookback - 1`` rows of spend of every entity before it,
    for trailing windows of up to ``lookback`` rows: reports over the range then equal those of a full run cut to it.
    """
    def read(name):
        df = _months(spark, root, name)
        if start is not None:
            s = F.lit(str(start)).cast("date")
            df = df.where((F.col(MONTH) >= _first_month(start)) & (F.col("date") >= s))
        if end is not None:
            e = F.lit(str(end)).cast("date")
            df = df.where((F.col(MONTH) <= _first_month(end)) & (F.col("date") <= e))
        return df.drop(MONTH)

    def history():
        months = history_months(spark, root, start, lookback - 1, keys)
        before = _months(spark, root, "spend").where(F.col(MONTH).isin(months) & (F.col("date") < F.lit(str(start)).cast("date")))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))
        return before.withColumn("_place", place).where(F.col("_place") <= lookback - 1).drop("_place", MONTH)

    sources = {name: (lambda name=name: read(name)) for name in _TABLES}
    if start is not None and lookback > 1:
        sources["history"] = history
    return Prepared(keys, **sources)
