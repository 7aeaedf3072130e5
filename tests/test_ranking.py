"""Row numbers and group sizes equal a plain window, NULLs and ties included."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from spendlens.operators.ranking import rank_within


def _check(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int, d int")
    got = rank_within(df, ["g"], ["v", "d"])
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first(), "d")
    ref = df.select("g", "v", "d", F.row_number().over(w).alias("rn2"),
                    F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n2"))
    bad = (got.join(ref, ["g", "d"]).where((F.col("rn") != F.col("rn2")) | (F.col("n") != F.col("n2"))).count())
    assert got.count() == len(rows)
    assert bad == 0


def test_hot_group(spark):
    rows = [("hot", 7 if i % 3 == 0 else i % 50, i) for i in range(3000)] + [("cold", i, i) for i in range(40)]
    _check(spark, rows)
    

@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.integers(0, 5))),
                min_size=1, max_size=60))
def test_matches_row_number(spark, pairs):
    rows = [(g, v, i) for i, (g, v) in enumerate(pairs)]
    _check(spark, rows)


def test_multi_column_group(spark):
    rows = [(f"e{i % 3}", "x", i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "e string, g string, v int, d int")
    got = rank_within(df, ["e", "g"], ["v", "d"])
    w = Window.partitionBy("e", "g").orderBy("v", "d")
    ref = df.select("e", "d", F.row_number().over(w).alias("rn2"))
    assert got.join(ref, ["e", "d"]).where(F.col("rn") != F.col("rn2")).count() == 0
