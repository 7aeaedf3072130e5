"""Readers and writers for the daily feeds.

Raw feeds may repeat a date; "first row wins" needs an arrival order, which files do not
carry as a column. Readers therefore add ``ingest_ord``, an orderable struct of
(file path, byte offset of the split, position). Parquet has an exact per-file row index;
CSV does not, so the split start plus the position inside the task stands in for it
(rows of one split are read in file order). Across files the order is the file path, so
feed drops should be named in arrival order (e.g. date-stamped).
"""

from __future__ import annotations

import uuid
from typing import Callable, Sequence, Union

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.session import hadoop_path
from spendlens.sources.schemas import MONEY, SCHEMAS

INGEST_ORD = "ingest_ord"


Source = Union[DataFrame, Callable[[], DataFrame]]


class Lazy:
    """Named DataFrames given directly or as zero-argument builders, built once on first use."""

    _names: tuple = ()

    def __init__(self, **sources: Source):
        unknown = set(sources) - set(self._names)
        if unknown:
            raise TypeError(f"unknown inputs {sorted(unknown)}")
        self._sources = dict(sources)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        if name not in self._built:
            if name not in self._sources:
                raise AttributeError(f"{type(self).__name__} has no {name!r} input")
            src = self._sources[name]
            self._built[name] = src if isinstance(src, DataFrame) else src()
        return self._built[name]


class Feeds(Lazy):
    """The three raw daily feeds (spend wide, revenue, factors); each may hold repeated dates."""

    _names = ("spend", "revenue", "factors")


def _parquet_order() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("_metadata.row_index").alias("row"),
    )


def _csv_order() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _exact_money(name: str) -> Column:
    """A money column read as text, as the declared DECIMAL; a value that it cannot hold fails the job."""
    wide = F.col(name).cast("decimal(38,14)")
    money = F.col(name).cast(MONEY)
    return F.when(F.col(name).isNotNull() & ~wide.eqNullSafe(money.cast("decimal(38,14)")),
                  F.raise_error(F.concat(F.lit(f"{name} does not fit {MONEY.simpleString()} (read it with real=True): "),
                                         F.col(name)))) \
        .otherwise(money).alias(name)


def read_feed(spark: SparkSession, path: str, name: str, fmt: str = "csv", keys: Sequence[str] = (),
              real: bool = False) -> DataFrame:
    """Read one feed with its declared schema (no inference) and an ``ingest_ord`` column.

    ``keys`` are further text columns that name an entity. Money is DECIMAL, and an amount that does not fit it fails the
    read; with ``real`` it is DOUBLE, which takes any number of digits, and sums of it are exact sums of the doubles.
    """
    declared = SCHEMAS[name]
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys]
                          + [T.StructField(f.name, T.DoubleType()) if real and f.dataType == MONEY else f for f in declared])
    if fmt == "csv":
        text = T.StructType([T.StructField(f.name, T.StringType() if f.dataType == MONEY else f.dataType) for f in schema])
        df = (spark.read.schema(text).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
              .option("dateFormat", "yyyy-MM-dd").csv(path))
        df = df.select(*[_exact_money(f.name) if f.dataType == MONEY else f.name for f in schema], "_metadata")
        order = _csv_order()
    elif fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
        order = _parquet_order()
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return df.select(*schema.fieldNames(), order.alias(INGEST_ORD))


def read_feeds(spark: SparkSession, spend: str, revenue: str, factors: str, fmt: str = "csv",
               keys: Sequence[str] = (), real: bool = False) -> Feeds:
    return Feeds(
        spend=read_feed(spark, spend, "marketing_spend", fmt, keys, real),
        revenue=read_feed(spark, revenue, "revenue", fmt, keys, real),
        factors=read_feed(spark, factors, "external_factors", fmt, keys, real),
    )


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 single_file: bool = False, quote_all: bool = False) -> None:
    """Export a result (replace-if-exists). ``single_file`` is for small, bounded reports only; ``quote_all`` puts
    every CSV field and the header in quotes.
    """
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quoteAll", quote_all).csv(path)
    else:
        writer.format(fmt).save(path)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _without_zeros(text: Column) -> Column:
    """A decimal fraction without its last zeros; one digit stays after the point."""
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def _published(name: str, kind: T.DataType) -> Column:
    """A value as the published files show it: numbers plain, text in quotes unless it is a word, NULL as nothing."""
    x = F.col(f"`{name}`")
    text = x.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        digits = 18 if isinstance(kind, T.DoubleType) else 9
        size = F.abs(x)
        plain = F.when((size >= 1e7) & (size < 1e19), text.try_cast(f"decimal(38,{digits})")) \
            .when((size < 1e-3) & (size >= 1e-18), text.try_cast("decimal(38,37)"))
        text = F.when(text.contains("E") & plain.isNotNull(), _without_zeros(plain.cast("string"))).otherwise(text)
    elif isinstance(kind, T.DecimalType):
        text = _without_zeros(text) if kind.scale else text
    elif not isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = F.when(text.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), text).otherwise(_quoted(text))
    return F.coalesce(text, F.lit(""))


def write_published(df: DataFrame, path: str) -> None:
    """Write a small, bounded report as the one CSV file ``path`` (replace-if-exists), in the published form.

    The header is quoted; see ``_published`` for the values. The rows are written by a task, in order, and the file gets
    its name only when it is whole, so a reader sees the old file or the new one.
    """
    spark = df.sparkSession
    rows = f"{path}.rows-{uuid.uuid4().hex}"
    lines = F.concat_ws(",", *[_published(f.name, f.dataType) for f in df.schema.fields])
    df.select(lines.alias("value")).coalesce(1).write.option("compression", "none").text(rows)
    folder, fs = hadoop_path(spark, rows)
    final, made = hadoop_path(spark, path)[0], hadoop_path(spark, f"{rows}.csv")[0]
    out = fs.create(made)
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n"
    out.write(bytearray(header.encode()))
    for part in sorted(s.getPath().toString() for s in fs.listStatus(folder)):
        if "/part-" in part:
            source = fs.open(hadoop_path(spark, part)[0])
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
    out.close()
    fs.delete(final, True)
    if not fs.rename(made, final):
        raise OSError(f"cannot name {made} {final}")
    fs.delete(folder, True)
