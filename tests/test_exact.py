"""Order-independent sums and moments, ranks on the values themselves, NULL entities, amounts of any precision."""

import math
import os
import random
import struct
import tempfile
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import COLS, day, factors_df, long_df, revenue_df, spend_df
from spendlens import operators as ops
from spendlens.functions import exact_mean, exact_sum, pearson, population_stddev
from spendlens.plans.inspect import plan_text
from spendlens.sources.feeds import read_feed

INF, NAN = float("inf"), float("nan")


def sums(spark, groups, parts=4):
    rows = [(g, x) for g, xs in enumerate(groups) for x in xs]
    df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
    out = {r["g"]: r["s"] for r in df.groupBy("g").agg(exact_sum("x").alias("s")).collect()}
    return [out.get(g) for g in range(len(groups))]


value = st.floats(min_value=-1e20, max_value=1e20).filter(lambda x: x == 0 or abs(x) > 1e-11)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(value, min_size=1, max_size=12), min_size=1, max_size=30))
def test_exact_sum_is_the_sum_rounded_once(spark, groups):
    for got, xs in zip(sums(spark, groups), groups):
        want = math.fsum(xs)
        # a total beyond 2^30 is cut at 2^-60, far below its last bit; smaller ones at 2^-90
        assert got == want or abs(Fraction(got) - sum(map(Fraction, xs))) <= max(abs(Fraction(want)) * Fraction(2) ** -53,
                                                                                Fraction(2) ** -80)


def test_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(2)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 14) for _ in range(3000)]
    seen = {struct.pack("d", sums(spark, [rng.sample(xs, len(xs))], parts)[0]) for parts in (1, 3, 8)}
    assert seen == {struct.pack("d", math.fsum(xs))}


def test_nulls_and_values_beyond_the_pieces(spark):
    got = sums(spark, [[None, 1.5, None], [None], [INF, 1.0], [1e300, 1e300], [NAN, 2.0], [INF, -INF], [-0.0], [2.0**90]])
    assert got[:4] == [1.5, None, INF, 2e300] and math.isnan(got[4]) and math.isnan(got[5]) and got[6] == 0
    assert got[7] == 2.0**90
    df = spark.createDataFrame([(0.1,), (0.2,), (None,)], "x double")
    assert df.agg(exact_mean("x").alias("m")).first()["m"] == math.fsum([0.1, 0.2]) / 2
    assert df.where("x > 1").agg(exact_mean("x").alias("m")).first()["m"] is None


# ------------------------------------------------------------------------ moments

def exact_stats(pairs):
    """Population sd of x and Pearson r, in fractions up to the square root."""
    n = len(pairs)
    x, y = [Fraction(a) for a, _ in pairs], [Fraction(b) for _, b in pairs]
    mx, my = sum(x) / n, sum(y) / n
    xx, yy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
    xy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return math.sqrt(xx / n), (None if not xx or not yy else float(xy) / math.sqrt(xx) / math.sqrt(yy))


money = st.decimals(min_value=-10**10, max_value=10**10, places=6)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(money, money), min_size=1, max_size=15))
def test_moments_of_decimals(spark, pairs):
    df = spark.createDataFrame(pairs, "x decimal(24,6), y decimal(24,6)").repartition(3)
    got = df.agg(population_stddev("x", 6).alias("s"), pearson("x", "y", 6, 6).alias("r")).first()
    sd, r = exact_stats(pairs)
    assert got["s"] == pytest.approx(sd, rel=1e-14, abs=1e-300)
    assert (got["r"] is None) == (r is None) and (r is None or got["r"] == pytest.approx(r, rel=1e-12, abs=1e-13))


def test_moments_have_the_same_bits_for_any_partitioning(spark):
    rng = random.Random(5)
    rows = [(Decimal(rng.randint(10**12, 10**12 + 10**7)) / 10**6, rng.uniform(0.5, 1.5)) for _ in range(4000)]
    seen = set()
    for parts in (1, 2, 7, 16):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "x decimal(24,6), y double").repartition(parts)
        got = df.agg(population_stddev("x", 6).alias("s"), pearson("x", "y", 6, None).alias("r")).first()
        seen.add((struct.pack("d", got["s"]), struct.pack("d", got["r"])))
    assert len(seen) == 1
    sd, r = exact_stats(rows)
    assert got["s"] == pytest.approx(sd, rel=1e-13) and got["r"] == pytest.approx(r, abs=1e-10)


def test_moments_of_values_that_do_not_fit(spark):
    big = [(Decimal(10**17) + 10**6 * i, 1e30 * i) for i in range(5)]
    got = spark.createDataFrame(big, "x decimal(24,6), y double").agg(
        population_stddev("x", 6).alias("s"), population_stddev("y").alias("t"), pearson("x", "y", 6).alias("r")).first()
    assert got["t"] == pytest.approx(1e30 * math.sqrt(2)) and got["s"] == pytest.approx(1e6 * math.sqrt(2)) and got["r"] == pytest.approx(1)
    tiny = spark.createDataFrame([(1e-20,), (3e-20,)], "x double").agg(population_stddev("x").alias("s")).first()
    assert tiny["s"] == pytest.approx(1e-20)
    none = spark.createDataFrame([], "x decimal(24,6), y double").agg(population_stddev("x", 6).alias("s"),
                                                                      pearson("x", "y", 6).alias("r")).first()
    assert none["s"] is None and none["r"] is None


# -------------------------------------------------------------------------- ranks

def fact(spark, rows):
    return spark.createDataFrame(rows, "date date, channel string, spend decimal(24,6), attributed_revenue double, r string")


def test_totals_close_together_rank_apart_and_equal_ones_tie(spark):
    one = Decimal(1)
    rows = [(day(0), "a", one, 1.0, None), (day(0), "b", one, 1.0 + 2e-10, None), (day(0), "c", one, 0.5, None)]
    got = {(r["metric"], r["channel"]) for r in ops.top_bottom(fact(spark, rows)).collect()}
    assert got == {("top_revenue", "b"), ("top_roas", "b"), ("bottom_revenue", "c"), ("bottom_roas", "c")}

    rng = random.Random(1)
    parts = [rng.uniform(0, 1e10) for _ in range(1000)]
    rows = [(day(i), c, one, x, None) for c in ("a", "b") for i, x in enumerate(rng.sample(parts, len(parts)))]
    rows += [(day(0), "c", Decimal(1000), 1.0, None)]
    for n in (1, 7):
        got = {(r["metric"], r["channel"]) for r in ops.top_bottom(fact(spark, rows).repartition(n)).collect()}
        assert got == {("top_revenue", "a"), ("top_revenue", "b"), ("top_roas", "a"), ("top_roas", "b"),
                       ("bottom_revenue", "c"), ("bottom_roas", "c")}


def test_null_ratios_rank_last_per_entity(spark):
    rows = [(day(0), c, Decimal(s), x, r) for r in ("east", None)
            for c, s, x in (("a", 1, 2.0), ("b", 0, 3.0), ("c", 0, 0.0), ("d", 4, 4.0))]
    got = {(r["r"], r["metric"], r["channel"]) for r in ops.top_bottom(fact(spark, rows), keys=["r"]).collect()}
    want = {("top_revenue", "d"), ("bottom_revenue", "c"), ("top_roas", "a"), ("bottom_roas", "b"), ("bottom_roas", "c")}
    assert got == {(r, *w) for r in ("east", None) for w in want}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_marked_ranks_are_those_of_a_window(spark, keys):
    rng = random.Random(len(keys))
    rows = [(rng.choice(["x", "y", None]), i, rng.choice([None, 0.0, 1.0, 2.0, 3.0, float(i)])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    for low, high in ((1, 1), (2, 3), (50, 2), (100, 100)):
        got = {r["i"]: (r["_is_low"], r["_is_high"]) for r in ops.mark_ranks(df, "v", low, high, keys).collect()}
        for k, i, v in rows:
            peers = [w for q, _, w in rows if w is not None and (not keys or q == k)]
            want = (False, False) if v is None else (1 + sum(w < v for w in peers) <= low, 1 + sum(w > v for w in peers) <= high)
            assert got[i] == want


def test_a_million_channels_rank_without_a_task_that_holds_them(spark):
    n = 1_000_000
    totals = spark.range(n).select(F.concat(F.lit("c"), F.col("id")).alias("channel"),
                                   (F.xxhash64("id") / 1e6).alias("roas_30d"), (F.col("id") < n).cast("string").alias("k"))
    for keys in ([], ["k"]):
        marked = ops.mark_ranks(totals, "roas_30d", 2, 3, keys)
        assert marked.where("_is_low").count() == 2 and marked.where("_is_high").count() == 3
        text = plan_text(marked)
        assert "TakeOrderedAndProject" in text if not keys else text.count("WindowGroupLimit") >= 4, text
        if not keys:
            assert "Window" not in text


def test_reallocation_with_many_channels(spark):
    n = 3000
    spend = spark.range(n).select(F.lit(day(0)).alias("date"), F.concat(F.lit("c"), F.col("id")).alias("channel"),
                                  (F.col("id") % 7 + 1).cast("decimal(24,6)").alias("spend"))
    out = ops.budget_reallocation(spend, revenue_df(spark, [(0, 100)])).collect()
    assert len(out) == n
    assert sum(r["new_total_spend"] for r in out) == pytest.approx(sum(r["total_spend"] for r in out), abs=0.02 * n)


# ---------------------------------------------------------------- entities and amounts

KEYS = ["region"]


def with_region(df, regions):
    return df.withColumn("region", F.explode(F.array(*[F.lit(r).cast("string") for r in regions])))


def test_a_null_entity_has_its_rows_in_every_keyed_report(spark):
    s = spend_df(spark, [(i, [i % 3 + 1, 2, 3, i % 5, 5, 6]) for i in range(40)])
    r = revenue_df(spark, [(i, 100 + i % 9) for i in range(38)])
    f = factors_df(spark, [(i, int(i % 7 in (5, 6)), 0, i % 2, 0.8 + 0.1 * (i % 5)) for i in range(39)])
    ss, rr, ff = (with_region(x, ["east", None]) for x in (s, r, f))
    long = ops.unpivot_channels(ss, keys=KEYS)
    fact30 = ops.attributed_fact(ss, rr, (30,), KEYS)
    keyed = {
        "channel_summary": ops.channel_summary(long, KEYS), "revenue_summary": ops.revenue_summary(rr, KEYS),
        "monthly_totals": ops.monthly_totals(ss, rr, KEYS), "dow_pattern": ops.dow_pattern(ss, rr, KEYS),
        "month_seasonality": ops.month_seasonality(ss, rr, ff, KEYS),
        "same_day": ops.same_day_attribution(ss, rr, KEYS), "rolling": ops.rolling_attribution(ss, rr, 7, KEYS),
        "rolling_long": ops.rolling_attribution(long, rr, 7, KEYS), "windows": ops.attribution_windows(ss, rr, keys=KEYS),
        "top_bottom": ops.top_bottom(fact30, KEYS), "month": ops.perf_by_month(fact30, KEYS),
        "day_type": ops.perf_by_day_type(fact30, ff, KEYS), "promo": ops.perf_by_promo(fact30, ff, KEYS),
        "cohort": ops.cohort_by_quarter(fact30, KEYS), "corr": ops.corr_spend_revenue(ss, rr, KEYS),
        "lift": ops.revenue_lift(rr, ff, KEYS), "season": ops.corr_revenue_seasonality(rr, ff, KEYS),
        "buckets": ops.seasonality_buckets(rr, ff, KEYS), "incr": ops.incrementality(ss, rr, KEYS),
        "quartile": ops.return_by_quartile(ss, rr, KEYS), "curve": ops.efficiency_curve(ss, rr, KEYS),
        "consistency": ops.spend_consistency(long, KEYS), "realloc": ops.budget_reallocation(ss, rr, keys=KEYS),
        "realloc_long": ops.budget_reallocation(long, rr, keys=KEYS),
        "null_gaps": ops.date_gaps(ss, keys=KEYS), "outliers": ops.outliers(rr, "revenue", 1.2, KEYS),
    }
    for name, df in keyed.items():
        rows = [r.asDict() for r in df.collect()]
        own = {reg: sorted((tuple(v for c, v in r.items() if c != "region") for r in rows if r["region"] == reg), key=repr)
               for reg in ("east", None)}
        assert own[None] and own[None] == own["east"], name


def test_amounts_with_many_digits_are_read_as_reals(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spendlens-real-"), "rev.csv")
    with open(path, "w") as out:
        out.write("date,revenue,transactions,new_customers\n2023-01-01,1234.123456789012,5,1\n2023-01-02,0.1,1,0\n")
    with pytest.raises(Exception, match="read it with real=True"):
        read_feed(spark, path, "revenue").collect()
    revenue = read_feed(spark, path, "revenue", real=True)
    assert [r["revenue"] for r in revenue.orderBy("date").collect()] == [1234.123456789012, 0.1]
    assert ops.revenue_summary(revenue).first()["total_revenue"] == math.fsum([1234.123456789012, 0.1])
    spend = spend_df(spark, [(0, [1, 2, 3, 4, 5, 6]), (1, [6, 5, 4, 3, 2, 1])]) \
        .select("date", *[F.col(c).cast("double").alias(c) for c in COLS])
    out = {r["channel"]: r for r in ops.rolling_attribution(spend, revenue, 7).collect()}
    assert out["tv"]["total_spend"] == 7.0
    assert out["tv"]["total_revenue_attributed_k"] == math.fsum([1234.123456789012 * (6 / 21), 0.1 * (7 / 42)])
    assert len(ops.budget_reallocation(spend, revenue).collect()) == 6
    assert ops.spend_consistency(ops.unpivot_channels(spend)).count() == 6


def test_row_order_of_weekdays_and_buckets(spark):
    s = spend_df(spark, [(i, [1, 2, 3, 4, 5, 6]) for i in range(14)])
    r = revenue_df(spark, [(i, 100 + i) for i in range(14)])
    f = factors_df(spark, [(i, 0, 0, 0, (1.2, 0.8, 1.0)[i % 3]) for i in range(14)])
    assert [x["dow"] for x in ops.dow_pattern(s, r).collect()] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert [x["bucket"] for x in ops.seasonality_buckets(r, f).collect()] == ["low_seasonality", "mid_seasonality",
                                                                              "high_seasonality"]
    months = spend_df(spark, [(31 * i, [1, 2, 3, 4, 5, 6]) for i in range(20)])
    order = [x["year_month"] for x in ops.monthly_totals(months, revenue_df(spark, [(31 * i, 1) for i in range(20)])).collect()]
    assert order == sorted(order)
    spends = [x["total_spend"] for x in ops.channel_summary(long_df(spark, [(0, "a", 1), (0, "b", 3), (1, "c", 2)])).collect()]
    assert spends == sorted(spends, reverse=True)
