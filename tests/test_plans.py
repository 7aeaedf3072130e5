"""Plan shape of the flagship and friends, and the prepared-table / report round trip."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF001
from spendlens.plans.inspect import plan_summary, plan_text
from spendlens.plans.prepared import prepare
from spendlens.plans.report import export_reports, reports
from spendlens.plans.store import load_prepared, save_prepared
from spendlens.sources.driver_tables import driver_feeds


def test_flagship_plan_shape(spark):
    s = plan_summary(entry.queries()["attribution_windows"](spark, SF001))
    assert s["cartesian"] == 0 and s["python_udfs"] == 0
    assert s["exchanges"] <= 5, s  # lineitem agg, orders agg, one window exchange, final agg, sort
    lineitem = [schema for loc, schema in s["scans"] if "lineitem" in loc]
    assert lineitem == ["struct<l_extendedprice:double,l_returnflag:string,l_linestatus:string,"
                        "l_shipdate:timestamp_ntz>"]


def test_no_query_uses_python_or_cartesian(spark):
    for name, q in ((n, entry.queries()[n]) for n in entry._BUILDERS):
        s = plan_summary(q(spark, SF001))
        assert s["cartesian"] == 0 and s["python_udfs"] == 0, name


def test_prepared_store_prunes_months(spark):
    root = tempfile.mkdtemp(prefix="spendlens-store-")
    p = prepare(driver_feeds(spark, SF001))
    save_prepared(p, root)
    q = load_prepared(spark, root, "1996-02-10", "1996-03-20")
    got = q.spend.agg(F.min("date"), F.max("date"), F.count(F.lit(1))).collect()[0]
    want = p.spend.where(F.col("date").between("1996-02-10", "1996-03-20")).count()
    assert str(got[0]) >= "1996-02-10" and str(got[1]) <= "1996-03-20" and got[2] == want
    text = plan_text(q.spend)
    assert "PartitionFilters: [isnotnull(year_month" in text and "PushedFilters" in text


def test_export_reports(spark):
    out = tempfile.mkdtemp(prefix="spendlens-report-")
    p = prepare(driver_feeds(spark, SF001))
    names = export_reports(p, out, names={"attribution_windows", "budget_reallocation"})
    assert sorted(names) == ["attribution_windows", "budget_reallocation"]
    df = spark.read.option("header", True).csv(os.path.join(out, "Attribution_windows.csv"))
    assert df.count() == 18
    assert len(reports(p)) == 29


def test_keep_first_limits_before_the_shuffle(spark):
    from spendlens import operators as ops
    from spendlens.sources.driver_tables import read_table
    orders = read_table(spark, SF001, "orders").withColumn("date", F.to_date("o_orderdate"))
    text = plan_text(ops.keep_first(orders, "date", "o_orderkey"))
    tree = text.split("\n\n")[0]
    # one WindowGroupLimit below the exchange (partial) and one above it (final)
    assert tree.count("WindowGroupLimit") == 2
    assert "Partial" in text and "Final" in text


def test_raw_aggregations_are_partial_before_exchange(spark):
    p = prepare(driver_feeds(spark, SF001))
    for df in (p.spend, p.revenue, p.factors):
        text = plan_text(df)
        assert "partial_sum" in text or "partial_count" in text or "partial_min" in text
        assert "SortAggregate" not in text


def test_wide_fact_has_one_window_shuffle(spark):
    from spendlens import operators as ops
    p = prepare(driver_feeds(spark, SF001))
    tree = plan_text(ops.attributed_fact(p.spend, p.revenue, (7, 14, 30))).split("\n\n")[0]
    # two dedup windows (spend, revenue); the trailing sums of all channels and all K are a
    # running-sum window and an offset (LAG) window over the same exchange and the same sort
    assert tree.count("Window (") == 4
    assert tree.count("Sort (") == 3
    # exchanges: lineitem aggregate, orders aggregate, the trailing window; no per-channel
    # or per-date shuffle
    assert plan_summary(ops.attributed_fact(p.spend, p.revenue, (7, 14, 30)))["exchanges"] == 3
