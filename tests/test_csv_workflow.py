"""The load-then-report workflow on whole fixture data: late duplicate rows in a second CSV
file must not change any report (the first row per date wins)."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF01
from spendlens.__main__ import run
from spendlens.plans.report import PUBLISHED
from spendlens.sources.driver_tables import driver_feeds
from spendlens.sources.feeds import INGEST_ORD

REPORTS = "attribution_windows,budget_reallocation,efficiency_curve,revenue_lift,monthly_totals"


def _write(df, path, name):
    df.drop(INGEST_ORD).coalesce(1).write.option("header", True).csv(os.path.join(path, name))


def _rows(spark, path):
    return spark.read.option("header", True).csv(path).collect()


def test_late_duplicates_do_not_change_reports(spark):
    root = tempfile.mkdtemp(prefix="spendlens-csv-")
    f = driver_feeds(spark, SF01)
    clean, dup = os.path.join(root, "clean"), os.path.join(root, "dup")
    for base in (clean, dup):
        _write(f.spend, base, "spend/part-a")
        _write(f.revenue, base, "revenue/part-a")
        _write(f.factors, base, "factors/part-a")
    # a later file re-sends every 7th date with different numbers and flags
    late = F.dayofmonth("date") % 7 == 0
    spend_cols = [c for c in f.spend.columns if c.endswith("_spend")]
    _write(f.spend.where(late).select("date", *[(F.col(c) * 2).cast("decimal(18,2)").alias(c) for c in spend_cols],
                                      INGEST_ORD), dup, "spend/part-b")
    _write(f.revenue.where(late).withColumn("revenue", (F.col("revenue") + 1).cast("decimal(18,2)")), dup,
           "revenue/part-b")
    _write(f.factors.where(late).withColumn("promotion_active", 1 - F.col("promotion_active")), dup,
           "factors/part-b")
    for base in (clean, dup):
        run(["--spend", os.path.join(base, "spend", "*"), "--revenue", os.path.join(base, "revenue", "*"),
             "--factors", os.path.join(base, "factors", "*"), "--out", os.path.join(base, "out"),
             "--only", REPORTS], spark)
    for name in REPORTS.split(","):
        file = PUBLISHED.get(name, f"{name}.csv")
        assert _rows(spark, os.path.join(clean, "out", file)) == _rows(spark, os.path.join(dup, "out", file)), name
