"""Data-quality operators: null profile (A01), date gaps (A02), outliers (A03, A04),
duplicate keys (A05).

All of them can work on counted rows: ``counted_rows`` is one aggregate over a raw feed, from which every report of it
follows, so that a suite reads each feed once.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.columns import row_total
from spendlens.sources.schemas import spend_columns


COUNT = "_copies"
_AT_ONCE = 10_000


def counted_rows(df: DataFrame) -> DataFrame:
    """The distinct rows of ``df`` with their number in ``_copies``; repeated rows merge before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COUNT))


def repeated(df: DataFrame, count_col: str = COUNT) -> DataFrame:
    """Every row as often as ``count_col`` says, without that column; made ``_AT_ONCE`` at a time, whatever the count."""
    n, kept = F.col(count_col), [c for c in df.columns if c != count_col]
    runs = df.where(n > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(
        f"(`{count_col}` - 1) div {_AT_ONCE}"))))
    size = F.least(n - F.col("_run") * _AT_ONCE, F.lit(_AT_ONCE)).cast("int")
    return runs.withColumn("_one", F.explode(F.array_repeat(F.lit(1), size))).select(*kept)


def _copies(df: DataFrame) -> tuple[Column, list[str]]:
    """How often a row counts, and the columns that are its own."""
    counted = COUNT in df.columns
    return F.col(COUNT) if counted else F.lit(1).cast("long"), [c for c in df.columns if c != COUNT]


def null_profile(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """NULL count of every column of every table: (table_name, column_name, missing_values, total_rows).

    One aggregation pass per table; the per-column counts are turned into rows afterwards. Tables may be counted rows.
    """
    parts = []
    for name, df in tables.items():
        n, own = _copies(df)
        cols = list((columns or {}).get(name, own))
        counts = df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_rows"),
                        *[F.coalesce(F.sum(F.when(F.col(c).isNull(), n)), F.lit(0)).alias(f"_n{i}")
                          for i, c in enumerate(cols)])
        entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("missing_values"))
                            for i, c in enumerate(cols)])
        parts.append(counts.select(F.lit(name).alias("table_name"), F.inline(entries),
                                   F.col("_rows").alias("total_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def date_gaps(df: DataFrame, date_col: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Each date whose previous calendar day is absent (per entity key): (keys, date, previous_date).

    Rows are first counted per date, so everything after one partial aggregate of the raw rows is calendar-sized: the
    date before, by LAG, is the day before or there is a gap; NULL dates are left out, repeated dates repeat, times of
    day do not count, and a NULL entity is an entity of its own. ``df`` may be counted rows.
    """
    keys = list(keys)
    days = (df.select(*keys, F.to_date(date_col).alias("date"), _copies(df)[0].alias("_n")).where(F.col("date").isNotNull())
            .groupBy(*keys, "date").agg(F.sum("_n").alias(COUNT)))
    before = F.lag("date").over(Window.partitionBy(*keys).orderBy("date"))
    gaps = (days.withColumn("previous_date", F.date_sub("date", 1)).withColumn("_before", before)
            .where(F.col("_before").isNull() | (F.col("_before") < F.col("previous_date"))))
    return repeated(gaps.select(*keys, "date", "previous_date", COUNT)).orderBy(*keys, "date")


def outliers(df: DataFrame, value_col: str, z: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with |x - mean| > z * population sd (per entity key), largest deviation first;
    input columns only.

    Without keys, mean and sd come from one global aggregate used as scalar subqueries (one
    row); with keys, from a per-entity aggregate joined back on the keys. ``df`` may be counted rows.
    """
    keys = list(keys)
    df = repeated(df) if COUNT in df.columns else df
    x = F.col(value_col).cast("double")
    if keys:
        stats = df.groupBy(*keys).agg(F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sigma"))
        entity = {k: f"_k{i}" for i, k in enumerate(keys)}
        stats = stats.withColumnsRenamed(entity)
        joined = df.join(stats, [df[k].eqNullSafe(stats[e]) for k, e in entity.items()])  # a NULL entity is one, too
        dev = F.abs(x - F.col("_mu"))
        return (joined.where(F.col("_sigma").isNotNull() & (dev > F.lit(z) * F.col("_sigma")))
                .orderBy(*keys, dev.desc()).select(*df.columns))
    stats = df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"))
    mu = stats.select("mu").scalar()
    sigma = stats.select("sigma").scalar()
    far = df.withColumn("_dev", F.abs(x - mu)).where(sigma.isNotNull() & (F.col("_dev") > F.lit(z) * sigma))
    return far.orderBy(F.col("_dev").desc()).drop("_dev")


def spend_outliers(spend_wide: DataFrame, z: float = 3.0, value_cols: Sequence[str] | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Outliers of the day's total spend (sum of the channel columns), on raw rows: (keys, date, spend)."""
    cols = list(value_cols or spend_columns())
    copies = [COUNT] if COUNT in spend_wide.columns else []
    ms = spend_wide.select(*keys, "date", row_total(cols).alias("spend"), *copies)
    return outliers(ms, "spend", z, keys)


def duplicate_keys(df: DataFrame, key="date", count_col: str = "num_occurrences") -> DataFrame:
    """Keys that occur more than once, with their count (partial aggregation absorbs hot keys); also of counted rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys).agg(F.sum(_copies(df)[0]).alias(count_col))
            .where(F.col(count_col) > 1))
