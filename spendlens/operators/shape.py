"""Reshaping operators: keep-first dedup (A06), wide-to-long unpivot (A07), densify."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.sources.feeds import INGEST_ORD
from spendlens.sources.schemas import CHANNELS, SPEND_SUFFIX


def _seq(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def keep_first(df: DataFrame, keys="date", order=INGEST_ORD) -> DataFrame:
    """One row per key: the first by an explicit order (arrival order by default).

    ``row_number() == 1`` lets Spark plan a WindowGroupLimit on both sides of the shuffle,
    so each task ships at most one row per key even when one key is very frequent.
    """
    keys, order = _seq(keys), _seq(order)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (df.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).drop("_rn"))


def unpivot_channels(wide: DataFrame, channels: Sequence[str] = CHANNELS, suffix: str = SPEND_SUFFIX,
                     keys: Sequence[str] = (), label_suffix: bool = False,
                     channel_col: str = "channel", value_col: str = "spend") -> DataFrame:
    """Wide channel columns to rows (keys, date, channel, spend): a single Expand, one scan.

    Labels are the channel names, or the column names when ``label_suffix`` is set.
    """
    ids = [*keys, "date"]
    renamed = wide.select(*ids, *[F.col(f"{c}{suffix}").alias(f"{c}{suffix}" if label_suffix else c)
                                  for c in channels])
    cols = [f"{c}{suffix}" if label_suffix else c for c in channels]
    return renamed.unpivot(ids, cols, channel_col, value_col)


def densify(long: DataFrame, channels: Sequence[str], keys: Sequence[str] = (), fill=0) -> DataFrame:
    """Add absent (date, channel) pairs with ``fill`` for every date present per key.

    A pivot over the known channel list followed by an unpivot: one aggregation keyed by
    (keys, date), no cross join. Rolling totals then agree whether taken per channel or
    on the daily total.
    """
    ids = [*keys, "date"]
    dtype = long.schema["spend"].dataType
    wide = long.groupBy(*ids).pivot("channel", list(channels)).agg(F.sum("spend"))
    wide = wide.select(*ids, *[F.coalesce(F.col(c), F.lit(fill).cast(dtype)).alias(c) for c in channels])
    return wide.unpivot(ids, list(channels), "channel", "spend")
