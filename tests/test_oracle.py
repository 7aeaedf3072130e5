"""The driver gate, locally: every registered query equals its DuckDB oracle."""

import pytest

import __spark_entry__ as entry
from conftest import SF001, SF01
from oracle_check import compare


def test_keys_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry._BUILDERS) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 18
    assert df.columns == ["channel", "attribution_window_days", "total_spend", "total_revenue_attributed_k", "roas_k"]


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_all_queries_match_oracle(spark, sf):
    res = compare(spark, sf, list(entry._BUILDERS), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] is not True}
    assert not bad, bad
