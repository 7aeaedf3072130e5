"""The command line: CSV feeds in, report files out."""

import os
import tempfile

from helpers import factors_df, revenue_df, spend_df
from spendlens.__main__ import run


def test_cli_round_trip(spark):
    root = tempfile.mkdtemp(prefix="spendlens-cli-")
    days = range(40)
    spend_df(spark, [(i, [i % 5 + 1, 2, 3, 4, 5, 6]) for i in days]).write.option("header", True).csv(
        os.path.join(root, "spend"))
    revenue_df(spark, [(i, 100 + i) for i in days]).write.option("header", True).csv(os.path.join(root, "rev"))
    factors_df(spark, [(i, int(i % 7 in (5, 6)), 0, i % 2, 1.0) for i in days]).write.option("header", True).csv(
        os.path.join(root, "ef"))
    run(["--spend", os.path.join(root, "spend"), "--revenue", os.path.join(root, "rev"),
          "--factors", os.path.join(root, "ef"), "--out", os.path.join(root, "out"),
          "--only", "attribution_windows,date_gaps"], spark)
    out = spark.read.option("header", True).csv(os.path.join(root, "out", "Attribution_windows.csv"))
    assert out.count() == 18
