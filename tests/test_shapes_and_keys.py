"""Long and wide spend give the same results; entity keys equal separate runs per entity."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from spendlens import operators as ops
from spendlens.plans.prepared import prepare
from spendlens.sources.driver_tables import driver_feeds


@pytest.fixture(scope="module")
def p(spark):
    return prepare(driver_feeds(spark, SF001))


def _round(v):
    return round(v, 6) if isinstance(v, float) else v


def _rows(df, cols=None):
    """Rows with doubles rounded to 6 digits (float sums depend on partition merge order)."""
    return sorted(tuple(_round(v) for v in r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize("windows", [(1,), (30,), (7, 14, 30)])
def test_long_equals_wide_fact(p, windows):
    wide = ops.attributed_fact(p.spend, p.revenue, windows)
    long = ops.attributed_fact(p.spend_long, p.revenue, windows)
    cols = ["date", "channel", "k", "spend", "rolling_spend", "total_rolling_spend", "attributed_revenue"]
    assert _rows(wide, cols) == _rows(long, cols)


def test_long_equals_wide_reallocation(p):
    assert _rows(ops.budget_reallocation(p.spend, p.revenue)) == _rows(ops.budget_reallocation(p.spend_long,
                                                                                               p.revenue))


def _two_entities(p):
    spend = p.spend.withColumn("acct", F.lit("a")).unionByName(
        p.spend.withColumn("acct", F.lit("b")).where(F.dayofmonth("date") != 3))
    rev = p.revenue.withColumn("acct", F.lit("a")).unionByName(p.revenue.withColumn("acct", F.lit("b")))
    return spend, rev


def test_entity_keys_match_single_runs(p):
    spend, rev = _two_entities(p)
    multi = ops.attribution_windows(spend, rev, keys=["acct"])
    for acct in ("a", "b"):
        single = ops.attribution_windows(spend.where(F.col("acct") == acct).drop("acct"),
                                         rev.where(F.col("acct") == acct).drop("acct"))
        assert _rows(multi.where(F.col("acct") == acct).drop("acct")) == _rows(single)


def test_entity_keys_curves_and_budget(p):
    spend, rev = _two_entities(p)
    for op in (ops.efficiency_curve, ops.budget_reallocation, ops.incrementality):
        multi = op(spend, rev, keys=["acct"])
        single = op(spend.where(F.col("acct") == "b").drop("acct"), rev.where(F.col("acct") == "b").drop("acct"))
        assert _rows(multi.where(F.col("acct") == "b").drop("acct")) == _rows(single)


def test_entity_keys_quality_checks(p):
    spend, rev = _two_entities(p)
    for acct in ("a", "b"):
        one = rev.where(F.col("acct") == acct).drop("acct")
        multi = ops.date_gaps(rev, keys=["acct"]).where(F.col("acct") == acct).drop("acct")
        assert _rows(multi) == _rows(ops.date_gaps(one))
        multi = ops.outliers(rev, "revenue", keys=["acct"]).where(F.col("acct") == acct).drop("acct")
        assert _rows(multi) == _rows(ops.outliers(one, "revenue"))
    # entity b misses day 3 of every month: its spend gaps are more than a's
    g = {r["acct"]: r["count"] for r in ops.date_gaps(spend, keys=["acct"]).groupBy("acct").count().collect()}
    assert g["b"] > g["a"]
