"""Equal-count bins of groups of any size, by histograms of counts in place of a row number.

A bin ends at the row of a known number (its target), so only the keys of these rows are needed. Each pass deals the
values between the smallest and the largest that a target can still have to ``CELLS`` cells and counts the rows of each:
counts merge, so a task offers at most ``CELLS`` rows per open interval, however many rows a group has. The cell that
holds the target is the next interval. An interval of ``FEW`` rows or fewer is finished by numbering its rows; one
whose rows are all equal goes on with the next order column. Rows then find their bin by comparing keys.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.joins import join_on
from spendlens.session import cut

CELLS = 1024
FEW = 100_000
#: Tables of so many open intervals or groups are broadcast; longer ones are joined by a shuffle.
MOST_BROADCAST = 50_000


def bin_ends(n: Column, bins: int) -> list[Column]:
    """Row numbers at which all bins but the last end, by the floor rule of ``ranking.equal_count_bin``."""
    return [F.expr(f"({b} * n + {bins - 1}) div {bins}") for b in range(1, bins)]


def lowest_end(n: Column, parts: int) -> list[Column]:
    """The row number at which the lowest 1 / parts of the rows ends (0: there is none)."""
    return [F.expr(f"n div {parts}")]


def _image(df: DataFrame, name: str) -> list[Column]:
    """Numbers that order as the column does, NULLs first and NaN last."""
    kind, x = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        infinite = float("inf")
        rank = F.when(x.isNull(), 0).when(F.isnan(x), 4).when(x == infinite, 3).when(x == -infinite, 1).otherwise(2)
        return [rank.cast("double"), F.when(rank == 2, x.cast("double")).otherwise(F.lit(0.0))]
    if isinstance(kind, T.DateType):
        x = F.unix_date(x)
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(x)
    elif isinstance(kind, T.TimestampNTZType):
        x = F.unix_micros(F.to_timestamp_ltz(x))
    elif not isinstance(kind, (T.DecimalType, T.IntegralType)):
        raise TypeError(f"cannot bin by {name}: {kind.simpleString()}")
    # a difference of two BIGINTs does not always fit one
    as_type = kind if isinstance(kind, T.DecimalType) else T.DecimalType(20, 0)
    return [x.isNotNull().cast("int"), F.coalesce(x.cast(as_type), F.lit(0).cast(as_type))]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def segments(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
             ends: Callable[[Column], list[Column]], out: str) -> DataFrame:
    """``df`` with ``out``: how many of the ``ends`` lie before the row, numbered in its group by ``order_cols``.

    ``ends`` makes row numbers of the group's size ``n``. ``order_cols`` should make the order total within a group
    (numbers, dates or timestamps; NULLs first); rows that tie in all of them are ordered by a hash of the whole row, and
    rows equal in every column share a segment. Several jobs run, each a pass over ``df``, which is written to the
    checkpoint folder first.
    """
    group = list(group_cols) or ["_all"]
    source = df if group_cols else df.withColumn("_all", F.lit(0))
    images = [i for c in order_cols for i in _image(df, c)] + [F.xxhash64(*df.columns).cast("decimal(20,0)")]
    dims = [f"_d{i}" for i in range(len(images))]
    rows = cut(source.select("*", *[i.alias(d) for i, d in zip(images, dims)]))

    sizes = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(dims[0]).alias("lo"), F.max(dims[0]).alias("hi")))
    targets = F.array(*[e.cast("long") for e in ends(F.col("n"))])
    left = sizes.select(*group, "n", "lo", "hi", F.posexplode(targets).alias("b", "target"), F.lit(0).cast("long").alias("before"))
    found = [left.where("target = 0").select(*group, "b", F.lit(None).cast(_key_type(rows, dims)).alias("key"))]
    left = cut(left.where("target > 0"))
    for i, dim in enumerate(dims):
        fixed = dims[:i]
        while True:
            found.append(_numbered(rows, left.where(F.col("n") <= FEW), group, fixed, dim, dims))
            left = left.where(F.col("n") > FEW)
            open_now = left.where("lo < hi").count()
            if not open_now:
                break
            refined = _refined(rows, left.where("lo < hi"), open_now, group, fixed, dim)
            left = cut(refined.unionByName(left.where("lo = hi")))
        n_left = left.count()
        if not n_left:
            break
        left = left.withColumn(dim, F.col("lo")).drop("lo", "hi")
        if i + 1 == len(dims):
            found.append(left.select(*group, "b", F.struct(*dims).alias("key")))
        else:
            left = cut(_next_range(rows, left, n_left, group, dims[:i + 1], dims[i + 1]))

    keys = found[0]
    for f in found[1:]:
        keys = keys.unionByName(f)
    of_group = cut(keys.groupBy(*group).agg(F.collect_list(F.struct("key")).alias("_ends")))  # one entry per end
    own = F.struct(*dims)
    passed = F.size(F.filter("_ends", lambda e: e["key"].isNull() | (e["key"] < own)))
    return join_on(rows, _small(of_group, of_group.count()), group, on=()) \
        .withColumn(out, passed.cast("long")).select(*df.columns, out)


def _key_type(rows: DataFrame, dims: Sequence[str]) -> str:
    return "struct<" + ",".join(f"{d}:{rows.schema[d].dataType.simpleString()}" for d in dims) + ">"


def _same(group: Sequence[str], other: str) -> list[Column]:
    return [F.col(f"r.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in group]


def _inside(rows: DataFrame, intervals: DataFrame, group, fixed, dim: str) -> DataFrame:
    """Rows (alias r) beside the interval (alias i) that holds them; intervals do not overlap."""
    on = _same(group, "i") + [F.col(f"r.{c}") == F.col(f"i.{c}") for c in fixed] + \
        [F.col(f"r.{dim}").between(F.col("i.lo"), F.col("i.hi"))]
    return rows.alias("r").join(intervals.alias("i"), on)


def _refined(rows: DataFrame, wide: DataFrame, n_wide: int, group, fixed, dim: str) -> DataFrame:
    """The targets with the cell of their interval that holds them: its range, rows and rows before it."""
    ids = [*group, *fixed, "lo", "hi"]
    inside = _inside(rows, _small(wide.select(*ids).distinct(), n_wide), group, fixed, dim)
    x, lo, hi = F.col(f"r.{dim}"), F.col("i.lo"), F.col("i.hi")
    share = F.try_divide((x / 2 - lo / 2).cast("double"), (hi / 2 - lo / 2).cast("double"))
    # the ends never share a cell, so every pass narrows an interval
    cell = F.when(x == hi, CELLS - 1).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1)))
    counts = inside.select(*[F.col(f"i.{c}").alias(c) for c in ids], cell.alias("cell"), F.col(f"r.{dim}").alias("x")) \
        .groupBy(*ids, "cell").agg(F.count(F.lit(1)).alias("cell_n"), F.min("x").alias("cell_lo"), F.max("x").alias("cell_hi"))
    earlier = Window.partitionBy(*ids).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("cell_before", F.coalesce(F.sum("cell_n").over(earlier), F.lit(0)))
    met = join_on(wide, counts, group, on=[*fixed, "lo", "hi"])
    place = F.col("target") - F.col("before") - F.col("cell_before")
    return met.where((place > 0) & (place <= F.col("cell_n"))).select(
        *group, *fixed, F.col("cell_n").alias("n"), F.col("cell_lo").alias("lo"), F.col("cell_hi").alias("hi"), "b",
        "target", (F.col("before") + F.col("cell_before")).alias("before"))


def _next_range(rows: DataFrame, left: DataFrame, n_left: int, group, fixed, dim: str) -> DataFrame:
    """The targets with the range of the next order column among the rows that are equal so far."""
    ids = [*group, *fixed]
    on = _same(group, "i") + [F.col(f"r.{c}") == F.col(f"i.{c}") for c in fixed]
    ranges = rows.alias("r").join(_small(left.select(*ids).distinct(), n_left).alias("i"), on) \
        .groupBy(*[F.col(f"i.{c}").alias(c) for c in ids]).agg(F.min(f"r.{dim}").alias("lo"), F.max(f"r.{dim}").alias("hi"))
    return join_on(left, ranges, group, on=fixed)


def _numbered(rows: DataFrame, few: DataFrame, group, fixed, dim: str, dims: Sequence[str]) -> DataFrame:
    """The keys of targets whose interval holds few rows, by numbering these rows."""
    ids = [*group, *fixed, "lo", "hi"]
    inside = _inside(rows, few.select(*ids).distinct(), group, fixed, dim) \
        .select(*[F.col(f"i.{c}").alias(c) for c in ids], F.struct(*[F.col(f"r.{d}").alias(d) for d in dims]).alias("key"))
    number = F.row_number().over(Window.partitionBy(*ids).orderBy("key"))
    met = join_on(few, inside.withColumn("_number", number), group, on=[*fixed, "lo", "hi"])
    return met.where(F.col("_number") == F.col("target") - F.col("before")).select(*group, "b", "key")
