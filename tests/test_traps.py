"""Hand-made rows for the semantic traps of the reference queries (one test per trap)."""

import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import COLS, day, factors_df, long_df, money, revenue_df, spend_df
from spendlens import operators as ops
from spendlens.operators.ranking import equal_count_bin, in_lowest_fraction, rank_within
from spendlens.plans.prepared import prepare
from spendlens.sources.feeds import Feeds, read_feed


def _csv(tmp, name, text):
    d = os.path.join(tmp, name)
    os.makedirs(d)
    with open(os.path.join(d, "part-0.csv"), "w") as fh:
        fh.write(text)
    return d


def test_t1_keep_first_follows_file_order_csv(spark):
    tmp = tempfile.mkdtemp(prefix="spendlens-t1-")
    path = _csv(tmp, "ef", "date,is_weekend,is_holiday,promotion_active,competitor_index,seasonality_index\n"
                           "2023-03-26,1,0,0,1.0,1.0\n"
                           "2023-03-26,1,1,0,1.0,1.0\n"
                           "2023-03-27,0,0,1,1.0,0.8\n")
    raw = read_feed(spark, path, "external_factors", "csv")
    assert ops.duplicate_keys(raw).collect()[0]["num_occurrences"] == 2
    first = ops.keep_first(raw).orderBy("date").collect()
    assert [r["is_holiday"] for r in first] == [0, 0]  # the first physical row wins


def test_t1_keep_first_follows_row_index_parquet(spark):
    tmp = tempfile.mkdtemp(prefix="spendlens-t1p-")
    rows = [(day(0), 1, 0, 0, 1.0, 1.0), (day(0), 1, 1, 0, 1.0, 1.0)]
    df = factors_df(spark, [(0, 1, 0, 0, 1.0), (0, 1, 1, 0, 1.0)]).coalesce(1)
    df.write.parquet(os.path.join(tmp, "p"))
    raw = read_feed(spark, os.path.join(tmp, "p"), "external_factors", "parquet")
    assert ops.keep_first(raw).collect()[0]["is_holiday"] == 0
    assert len(rows) == 2


def test_a02_gaps_hole_and_first_date(spark):
    r = revenue_df(spark, [(0, 1), (1, 1), (4, 1), (4, 1)])
    got = [(x["date"], x["previous_date"]) for x in ops.date_gaps(r).collect()]
    # first date always reports; the 2-day hole reports once (its last day); duplicates repeat
    assert got == [(day(0), day(-1)), (day(4), day(3)), (day(4), day(3))]


def test_t8_null_date_does_not_empty_gap_report(spark):
    r = revenue_df(spark, [(0, 1), (2, 1)]).unionByName(
        spark.createDataFrame([(None, money(1), 1, 0)], "date date, revenue decimal(18,2), transactions bigint, "
                                                         "new_customers bigint"))
    assert ops.date_gaps(r).count() == 2


def test_t16_zero_spend_day_attributes_zero(spark):
    s = spend_df(spark, [(0, [0, 0, 0, 0, 0, 0]), (1, [1, 2, 3, 4, 5, 5])])
    r = revenue_df(spark, [(0, 100), (1, 200)])
    fact = ops.attributed_fact(s, r, (1,)).where(F.col("date") == day(0)).collect()
    assert len(fact) == 6 and all(x["attributed_revenue"] == 0.0 for x in fact)
    # ratio of means on a zero-spend bin is NULL, not an error
    out = ops.efficiency_curve(s.where(F.col("date") == day(0)), r, bins=10).collect()
    assert all(x["avg_roas"] is None for x in out)


def test_t14_null_spend_behaviour(spark):
    s = spend_df(spark, [(0, [None, 1, 1, 1, 1, 1]), (1, [2, 1, 1, 1, 1, 1])])
    r = revenue_df(spark, [(0, 100), (1, 100)])
    # rolling attribution: SUM skips the NULL; the channel is only credited on day 1
    roll = {x["channel"]: x for x in ops.rolling_attribution(s, r, 2).collect()}
    assert roll["paid_search"]["total_spend"] == Decimal("2.00")
    # monthly totals: a NULL channel makes the day's total NULL
    mt = ops.monthly_totals(s, r).collect()[0]
    assert mt["total_spend"] == Decimal("7.00")  # day 0 contributes nothing
    # reallocation treats NULL as 0
    s29 = {x["channel"]: x for x in ops.channel_roas_summary(s, r, 30).collect()}
    assert s29["paid_search_spend"]["total_spend"] == Decimal("2.00")


def test_t10_t11_null_flags_and_index(spark):
    s = spend_df(spark, [(0, [1] * 6), (1, [1] * 6), (2, [1] * 6)])
    r = revenue_df(spark, [(0, 10), (1, 20), (2, 30)])
    f = spark.createDataFrame([(day(0), None, 0, None, 1.0, None), (day(1), 1, 1, 1, 1.0, 0.5),
                               (day(2), 0, 0, 0, 1.0, 1.0)],
                              "date date, is_weekend int, is_holiday int, promotion_active int, "
                              "competitor_index double, seasonality_index double")
    fact = ops.attributed_fact(s, r, (30,))
    dt_ = {x["day_type"] for x in ops.perf_by_day_type(fact, f).collect()}
    assert dt_ == {"weekday", "weekend"}
    wk = {(x["day_type"], x["channel"]): x for x in ops.perf_by_day_type(fact, f).collect()}
    assert wk[("weekday", "tv")]["total_spend"] == Decimal("2.00")  # NULL flag counts as weekday
    lift = {x["factor"]: x for x in ops.revenue_lift(r, f).collect()}
    assert lift["weekend"]["avg_treated"] == 20.0 and lift["weekend"]["avg_control"] == 30.0  # NULL in neither arm
    b = {x["bucket"]: x["num_days"] for x in ops.seasonality_buckets(r, f).collect()}
    assert b == {"low_seasonality": 1, "mid_seasonality": 1, "high_seasonality": 1}  # NULL index -> high


def test_t12_spend_day_without_revenue(spark):
    s = spend_df(spark, [(0, [1] * 6), (1, [1] * 6)])
    r = revenue_df(spark, [(1, 60)])
    a14 = ops.rolling_attribution(s, r, 30).collect()
    assert all(x["total_spend"] == Decimal("1.00") for x in a14)  # day 0 dropped at the join
    a29 = ops.channel_roas_summary(s, r, 30).collect()
    assert all(x["total_spend"] == Decimal("2.00") for x in a29)  # kept with revenue 0
    # the rolling sum still saw day 0: share of day 1 uses two days of spend
    assert sum(x["total_revenue_attributed_k"] for x in a14) == pytest.approx(60.0)


def test_t13_densify_long_input(spark):
    rows = [(0, c, 1) for c in ("a", "b")] + [(1, "a", 1)]
    d = ops.densify(long_df(spark, rows), ["a", "b"]).orderBy("date", "channel").collect()
    assert [(x["channel"], x["spend"]) for x in d] == [("a", 1), ("b", 1), ("a", 1), ("b", 0)]


def test_t4_constant_spend_gives_null_correlation_and_zero_cv(spark):
    s = spend_df(spark, [(i, [5, i, i, i, i, i]) for i in range(5)])
    r = revenue_df(spark, [(i, 10 + i) for i in range(5)])
    c = {x["channel"]: x["pearson_corr_spend_vs_revenue"] for x in ops.corr_spend_revenue(s, r).collect()}
    assert c["paid_search"] is None and c["tv"] == pytest.approx(1.0)
    cv = {x["channel"]: x for x in ops.spend_consistency(prepare(Feeds(spend=s.withColumn("ingest_ord", F.lit(1)),
                                                                        revenue=r, factors=r)).spend_long).collect()}
    assert cv["paid_search"]["cv_spend"] == 0.0 and cv["paid_search"]["stddev_spend"] == 0.0


def test_t5_population_sd(spark):
    s = long_df(spark, [(0, "a", 1), (1, "a", 3)])
    out = ops.spend_consistency(s).collect()[0]
    assert out["stddev_spend"] == pytest.approx(1.0)  # sample sd would be 1.414


def test_t6_quarter_labels(spark):
    s = spend_df(spark, [(i, [1] * 6) for i in (0, 45, 100, 300)])
    r = revenue_df(spark, [(i, 1) for i in (0, 45, 100, 300)])
    q = {x["period_quarter"] for x in ops.cohort_by_quarter(ops.attributed_fact(s, r, (30,))).collect()}
    assert q == {"2023-Q1", "2023-Q2", "2023-Q4"}


def test_w3_tied_spend_ordered_by_date(spark):
    s = long_df(spark, [(i, "a", 7) for i in range(4)])
    r = rank_within(s, ["channel"], ["spend", "date"]).orderBy("rn").collect()
    assert [x["date"] for x in r] == [day(i) for i in range(4)]


def test_t15_tied_roas_ranks(spark):
    # paid_search and paid_social have identical spend every day, so identical ROAS: RANK keeps
    # both as top (or bottom) whatever order the partial sums were merged in
    s = spend_df(spark, [(i, [2 + i % 3, 2 + i % 3, 4, 3 + i % 2, 4, 4]) for i in range(40)]).repartition(7)
    r = revenue_df(spark, [(i, 100 + 7 * i) for i in range(40)])
    tb = ops.top_bottom(ops.attributed_fact(s, r, (30,))).collect()
    by_metric = {}
    for x in tb:
        by_metric.setdefault(x["metric"], set()).add(x["channel"])
    # so have display, affiliate and tv, at a constant spend
    assert by_metric["bottom_roas"] == {"paid_search", "paid_social"}
    assert by_metric["top_roas"] == {"display", "affiliate", "tv"}
    realloc = {x["channel"]: x for x in ops.budget_reallocation(s, r).collect()}
    recipients = {c for c, x in realloc.items() if x["new_total_spend"] > x["total_spend"]}
    assert recipients == {"display_spend", "affiliate_spend", "tv_spend"}  # three tied at rank 1
    a, b = realloc["paid_search_spend"], realloc["paid_social_spend"]
    assert a["roas_30d"] == b["roas_30d"] and a["new_total_spend"] == b["new_total_spend"]
    total_before = sum(x["total_spend"] for x in realloc.values())
    total_after = sum(x["new_total_spend"] for x in realloc.values())
    assert total_after == pytest.approx(total_before, abs=0.05)


@pytest.mark.parametrize("n,bins,expected", [
    (728, 10, [73, 73, 73, 73, 72, 73, 73, 73, 73, 72]),
    (3, 10, None),
])
def test_t3_floor_bins(spark, n, bins, expected):
    df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("v"))
    r = rank_within(df, ["g"], ["v"]).withColumn("bin", equal_count_bin("rn", "n", bins))
    sizes = {x["bin"]: x["count"] for x in r.groupBy("bin").count().collect()}
    low = r.where(in_lowest_fraction("rn", "n", 10)).count()
    if expected:
        assert [sizes[b] for b in range(1, bins + 1)] == expected
        assert low == 72
    else:
        assert sorted(sizes) == [1, 4, 7] and low == 0


def test_nulls_rank_first(spark):
    s = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 1, 3)], "g string, v int, d int")
    r = {x["d"]: x["rn"] for x in rank_within(s, ["g"], ["v", "d"]).collect()}
    assert r == {1: 1, 3: 2, 2: 3}


def test_d7_calendar_window_option(spark):
    # days 0, 1, 3 (day 2 missing); K = 2 rows reaches back to day 1 for day 3, K = 2 days does not
    s = long_df(spark, [(i, "a", v) for i, v in ((0, 1), (1, 2), (3, 4))]).unionByName(
        long_df(spark, [(i, "b", 1) for i in (0, 1, 3)]))
    r = revenue_df(spark, [(3, 100)])
    rows = {x["channel"]: x["rolling_spend"] for x in ops.attributed_fact(s, r, (2,)).collect()}
    days = {x["channel"]: x["rolling_spend"] for x in ops.attributed_fact(s, r, (2,), frame="days").collect()}
    assert rows == {"a": 6, "b": 2} and days == {"a": 4, "b": 1}
    wide = s.groupBy("date").pivot("channel", ["a", "b"]).agg(F.first("spend"))
    wide = wide.select("date", F.col("a").alias("a_spend"), F.col("b").alias("b_spend"))
    wdays = {x["channel"]: x["rolling_spend"]
             for x in ops.attributed_fact(wide, r, (2,), channels=("a", "b"), frame="days").collect()}
    assert wdays == days
