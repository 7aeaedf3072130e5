"""Spark operators against a literal row-by-row implementation on random small feeds."""

import os
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from helpers import day, revenue_df
from spendlens import operators as ops
from spendlens.sources.schemas import MARKETING_SPEND

EXAMPLES = int(os.environ.get("BRUTE_EXAMPLES", "6"))
CH = ("paid_search", "paid_social", "display", "email", "affiliate", "tv")

cents = st.one_of(st.none(), st.integers(0, 500))
feed = st.lists(st.tuples(st.lists(cents, min_size=6, max_size=6), st.one_of(st.none(), st.integers(0, 10000))),
                min_size=1, max_size=12)


def _frames(spark, rows):
    spend, revenue = {}, {}
    data, rev_rows = [], []
    for i, (vals, rev) in enumerate(rows):
        d = day(i)
        spend[d] = {c: (None if v is None else v / 100) for c, v in zip(CH, vals)}
        data.append((d, *[None if v is None else Decimal(v) / 100 for v in vals]))
        if rev is not None:  # no revenue row on that day (spend day without revenue)
            revenue[d] = rev / 100
            rev_rows.append((i, rev / 100))
    return spend, revenue, spark.createDataFrame(data, MARKETING_SPEND), revenue_df(spark, rev_rows or [(999, 0)])


@settings(max_examples=EXAMPLES, deadline=None)
@given(feed, st.sampled_from([1, 2, 3, 7]))
def test_rolling_attribution_matches_brute_force(spark, rows, k):
    spend, revenue, sdf, rdf = _frames(spark, rows)
    want = brute.rolling_attribution(spend, revenue, k)
    got = {r["channel"]: r for r in ops.rolling_attribution(sdf, rdf, k).collect()}
    assert set(got) == set(want)
    for c, (ts, ta, roas) in want.items():
        g = got[c]
        assert (None if g["total_spend"] is None else float(g["total_spend"])) == pytest.approx(ts)
        assert g["total_revenue_attributed_k"] == pytest.approx(ta)
        assert g["roas_k"] == pytest.approx(roas)


@settings(max_examples=EXAMPLES, deadline=None)
@given(feed)
def test_reallocation_matches_brute_force(spark, rows):
    spend, revenue, sdf, rdf = _frames(spark, rows)
    want = brute.reallocation(spend, revenue)
    got = {r["channel"]: r for r in ops.budget_reallocation(sdf, rdf).collect()}
    assert set(got) == set(want)
    for c, (s, roas, new) in want.items():
        assert got[c]["total_spend"] == pytest.approx(round(s, 2))
        assert got[c]["roas_30d"] == pytest.approx(round(roas, 6), abs=1e-6)
        assert got[c]["new_total_spend"] == pytest.approx(round(new, 2), abs=0.011)


@settings(max_examples=EXAMPLES, deadline=None)
@given(feed, st.sampled_from([4, 10]))
def test_curves_match_brute_force(spark, rows, bins):
    spend, revenue, sdf, rdf = _frames(spark, rows)
    want_bins, want_incr = brute.curves(spend, revenue, bins)
    op = ops.return_by_quartile if bins == 4 else ops.efficiency_curve
    label, rev = ("quartile", "avg_attr_revenue") if bins == 4 else ("decile", "avg_attr_rev")
    got = {(r["channel"], r[label]): r for r in op(sdf, rdf).collect()}
    assert set(got) == set(want_bins)
    for key, (avg_s, avg_a) in want_bins.items():
        assert got[key]["avg_spend"] == pytest.approx(avg_s)
        assert got[key][rev] == pytest.approx(avg_a)
    incr = {r["channel"]: r for r in ops.incrementality(sdf, rdf).collect()}
    assert set(incr) == set(want_incr)
    for c, (base, higher) in want_incr.items():
        assert incr[c]["baseline_attr_rev"] == pytest.approx(base)
        assert incr[c]["higher_spend_attr_rev"] == pytest.approx(higher)
