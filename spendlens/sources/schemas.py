"""Declared schemas of the three daily feeds (spend by channel, revenue, external factors)."""

from __future__ import annotations

from pyspark.sql import types as T

# The channel names of the wide spend feed, in the feed's column order.
CHANNELS = ("paid_search", "paid_social", "display", "email", "affiliate", "tv")
SPEND_SUFFIX = "_spend"

# Money is exact: summed in DECIMAL, divided in DOUBLE. Six digits after the point hold amounts below a cent.
MONEY = T.DecimalType(24, 6)


def spend_columns(channels=CHANNELS, suffix: str = SPEND_SUFFIX) -> list[str]:
    return [f"{c}{suffix}" for c in channels]


MARKETING_SPEND = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, MONEY) for c in spend_columns()]
)

REVENUE = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("revenue", MONEY),
    T.StructField("transactions", T.LongType()),
    T.StructField("new_customers", T.LongType()),
])

EXTERNAL_FACTORS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("is_holiday", T.IntegerType()),
    T.StructField("promotion_active", T.IntegerType()),
    T.StructField("competitor_index", T.DoubleType()),
    T.StructField("seasonality_index", T.DoubleType()),
])

SCHEMAS = {"marketing_spend": MARKETING_SPEND, "revenue": REVENUE, "external_factors": EXTERNAL_FACTORS}
