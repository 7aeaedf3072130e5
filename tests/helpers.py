"""Small builders for hand-made feed rows."""

import datetime as dt
from decimal import Decimal

from spendlens.sources.schemas import EXTERNAL_FACTORS, MARKETING_SPEND, REVENUE, spend_columns

D0 = dt.date(2023, 1, 1)


def day(i: int) -> dt.date:
    return D0 + dt.timedelta(days=i)


def money(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def spend_df(spark, rows):
    """rows: (day_index, [six spends])"""
    data = [(day(i), *[money(v) for v in vals]) for i, vals in rows]
    return spark.createDataFrame(data, MARKETING_SPEND)


def revenue_df(spark, rows):
    """rows: (day_index, revenue[, transactions, new_customers])"""
    data = []
    for r in rows:
        i, rev = r[0], r[1]
        tx = r[2] if len(r) > 2 else 1
        nc = r[3] if len(r) > 3 else 0
        data.append((day(i), money(rev), tx, nc))
    return spark.createDataFrame(data, REVENUE)


def factors_df(spark, rows):
    """rows: (day_index, is_weekend, is_holiday, promotion_active, seasonality_index)"""
    data = [(day(i), w, h, p, 1.0, s) for i, w, h, p, s in rows]
    return spark.createDataFrame(data, EXTERNAL_FACTORS)


def long_df(spark, rows):
    """rows: (day_index, channel, spend)"""
    return spark.createDataFrame([(day(i), c, money(v)) for i, c, v in rows],
                                 "date date, channel string, spend decimal(18,2)")


COLS = spend_columns()
