"""Groups and series of any size, ranges of dates, loads one after the other, one read per feed, published files."""

import datetime as dt
import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF001
from helpers import COLS, D0, day, factors_df, revenue_df, spend_df
from spendlens import operators as ops
from spendlens.__main__ import run
from spendlens.operators import bins, blocks
from spendlens.operators.attribution import attributed_fact
from spendlens.plans import arrivals
from spendlens.plans.inspect import executed_scans
from spendlens.plans.prepared import Prepared, prepare
from spendlens.plans.report import QUALITY, counted_feeds, reports
from spendlens.plans.store import history_months, load_prepared, save_prepared
from spendlens.sources.driver_tables import driver_feeds
from spendlens.sources.feeds import INGEST_ORD, Feeds, read_feed, write_published


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --------------------------------------------------------------------------- bins

def numbered(rows, ends):
    """How many ends lie before each (group, i, v) row, in the order of v (NULL first, NaN last), then i."""
    out, by_group = {}, {}
    for g, i, v in rows:
        by_group.setdefault(g, []).append((v is not None, v is not None and math.isnan(v),
                                           0 if v is None or math.isnan(v) else v, i))
    for g, members in by_group.items():
        cuts = ends(len(members))
        for rn, (_, _, _, i) in enumerate(sorted(members), start=1):
            out[i] = sum(c < rn for c in cuts)
    return out


@pytest.mark.parametrize("cells, few", [(1024, 100_000), (4, 5), (3, 0)])
def test_segments_are_those_of_row_numbers(spark, monkeypatch, cells, few):
    monkeypatch.setattr(bins, "CELLS", cells)
    monkeypatch.setattr(bins, "FEW", few)
    rng = random.Random(cells)
    inf, nan = float("inf"), float("nan")
    pool = [None, nan, inf, -inf, 0.0, 0.0, 0.0, 1e300, -1e300, 1e-300, 3.5]
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([*pool, rng.uniform(-5, 5), rng.uniform(-5, 5)]))
            for i in range(70)] + [("tiny", 900, 1.0)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(4)
    for ends, plain in ((lambda n: ops.bin_ends(n, 10), lambda n: [-(-b * n // 10) for b in range(1, 10)]),
                        (lambda n: ops.lowest_end(n, 10), lambda n: [n // 10])):
        got = {r["i"]: r["part"] for r in ops.segments(df, ["g"], ["v", "i"], ends, "part").collect()}
        assert got == numbered(rows, plain)
    one = [(0, i, v) for _, i, v in rows]
    got = {r["i"]: r["part"] for r in ops.segments(df.drop("g"), [], ["v", "i"], lambda n: ops.bin_ends(n, 4), "part").collect()}
    assert got == numbered(one, lambda n: [-(-b * n // 4) for b in range(1, 4)])


def test_segments_of_ties_and_nothing(spark):
    same = spark.createDataFrame([("a", 1.0)] * 9 + [("a", 2.0)], "g string, v double")
    got = ops.segments(same, ["g"], ["v"], lambda n: ops.bin_ends(n, 2), "part").collect()
    assert [r["part"] for r in sorted(got, key=lambda r: r["v"])] == [0] * 9 + [1]
    assert ops.segments(same.where("v > 5"), ["g"], ["v"], lambda n: ops.bin_ends(n, 2), "part").collect() == []
    with pytest.raises(TypeError):
        ops.segments(same, [], ["g"], lambda n: ops.bin_ends(n, 2), "part")


def test_ten_million_rows_of_one_channel(spark):
    n, parts = 10_000_000, 10
    df = spark.range(n).select(F.lit("c").alias("channel"), (F.xxhash64("id") % 1_000_000_007).alias("spend"), "id")
    out = ops.segments(df, ["channel"], ["spend", "id"], lambda x: ops.bin_ends(x, parts), "part")
    got = {r["part"]: (r["n"], r["low"], r["high"]) for r in out.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("spend").alias("low"), F.max("spend").alias("high")).collect()}
    assert [got[b][0] for b in range(parts)] == [n // parts] * parts
    assert all(got[b][2] <= got[b + 1][1] for b in range(parts - 1))


@pytest.mark.parametrize("few", [100_000, 3])
def test_curves_of_any_size_equal_those_of_windows(spark, monkeypatch, few):
    monkeypatch.setattr(bins, "FEW", few)
    p = entry._prepared(spark, SF001)
    for op in (ops.efficiency_curve, ops.return_by_quartile, ops.incrementality):
        assert op(p.spend, p.revenue, any_size=True).collect() == op(p.spend, p.revenue).collect()


# ------------------------------------------------------------------------- blocks

def random_series(rng, entities=("x", "y", None), n=70):
    rows = []
    for e in entities:
        for i in sorted(rng.sample(range(3 * n), rng.randint(1, n))):
            rows.append((e, day(i), *[rng.choice([None, rng.randint(0, 500) / 100]) for _ in COLS]))
    return rows


@pytest.mark.parametrize("steps, frame", [(1, "rows"), (20, "rows"), (1000, "rows"), (3, "days"), (50, "days")])
def test_blocks_equal_the_whole_window(spark, steps, frame):
    rng = random.Random(steps)
    spend = spark.createDataFrame(random_series(rng), "e string, date date, " + ", ".join(f"{c} double" for c in COLS))
    spend = spend.select("e", "date", *[F.col(c).cast("decimal(24,6)").alias(c) for c in COLS])
    revenue = spend.select("e", "date", F.lit(100).cast("decimal(24,6)").alias("revenue")).where("day(date) % 4 > 0")
    long = ops.unpivot_channels(spend, keys=["e"]).where("spend IS NOT NULL OR day(date) % 2 = 0")
    doubles = spend.select("e", "date", *[F.col(c).cast("double").alias(c) for c in COLS])
    for s in (spend, long, doubles):
        for windows in ((1, 2, 7), (30,)):
            whole = attributed_fact(s, revenue, windows, ["e"], frame=frame)
            cut = attributed_fact(s, revenue, windows, ["e"], frame=frame, block_steps=steps)
            if s is doubles:
                assert rows_of(cut.selectExpr("e", "date", "channel", "k", "round(rolling_spend, 9)")) == \
                    rows_of(whole.selectExpr("e", "date", "channel", "k", "round(rolling_spend, 9)"))
            else:
                assert rows_of(cut) == rows_of(whole)
    if frame == "rows":
        for s in (spend, long):
            assert ops.budget_reallocation(s, revenue, 7, keys=["e"], block_steps=steps).collect() == \
                ops.budget_reallocation(s, revenue, 7, keys=["e"]).collect()


def test_ten_million_steps_of_one_entity(spark):
    n, k, steps = 10_000_000, 30, 500_000
    series = spark.range(n).select(F.lit("c").alias("channel"), F.col("id").alias("date"),
                                   (F.xxhash64("id") % 1000).cast("decimal(24,6)").alias("spend"))
    revenue = spark.range(n).select(F.col("id").alias("date"), F.lit(1).cast("decimal(24,6)").alias("revenue"))

    def check(**options):
        fact = attributed_fact(series, revenue, (k,), **options)
        return fact.agg(F.count(F.lit(1)), F.sum("rolling_spend"), F.sum(F.col("rolling_spend") * (F.col("date") % 1009)),
                        F.min("rolling_spend"), F.max("rolling_spend")).first()

    assert check(block_steps=steps) == check()
    sizes = ops.in_blocks(series.withColumn(blocks.HALO, F.lit(False)), ["channel"], steps, k) \
        .groupBy(blocks.BLOCK).count().collect()
    assert len(sizes) == n // steps and max(r["count"] for r in sizes) == steps + k - 1


# ----------------------------------------------------------------- ranges of dates

def feeds_of(spark, n=200, entities=("x", None)):
    rng = random.Random(n)
    days = sorted(rng.sample(range(2 * n), n))
    s = spend_df(spark, [(i, [rng.randint(0, 900) for _ in COLS]) for i in days])
    r = revenue_df(spark, [(i, rng.randint(1, 10**6)) for i in range(2 * n) if i % 5])
    f = factors_df(spark, [(i, int(i % 7 in (5, 6)), 0, i % 2, 1.0) for i in range(2 * n)])
    with_e = lambda df: df.withColumn("e", F.explode(F.array(*[F.lit(e).cast("string") for e in entities])))
    # the entity without a name rests for months
    return Prepared(["e"], spend=with_e(s).where("e IS NOT NULL OR date < '2023-03-10' OR date > '2023-11-01'"),
                    revenue=with_e(r), factors=with_e(f))


def test_reports_over_a_range_equal_the_full_run_cut_to_it(spark):
    root = tempfile.mkdtemp(prefix="spendlens-range-")
    whole = feeds_of(spark)
    save_prepared(whole, root)
    for start, end in (("2023-11-05", "2023-12-20"), ("2023-01-10", "2023-02-02"), ("2023-01-01", None)):
        part = load_prepared(spark, root, start, end, ["e"])
        inside = F.col("date").between(start, end or "9999-12-31")
        for windows in ((7, 14, 30), (1,)):
            assert rows_of(attributed_fact(part.spend, part.revenue, windows, ["e"], history=part.history)) == \
                rows_of(attributed_fact(whole.spend, whole.revenue, windows, ["e"]).where(inside))
        fact = attributed_fact(whole.spend, whole.revenue, (30,), ["e"]).where(inside)
        got = {n: build() for n, build in reports(part).items() if n not in QUALITY}
        assert rows_of(got["perf_by_month"]) == rows_of(ops.perf_by_month(fact, ["e"]))
        assert rows_of(got["top_bottom"]) == rows_of(ops.top_bottom(fact, ["e"]))
        cut = {c: rows_of(df.where(inside)) for c, df in (("spend", whole.spend), ("revenue", whole.revenue))}
        assert rows_of(part.spend.select(*whole.spend.columns)) == cut["spend"]
        moved = ops.channel_roas_summary(part.spend, part.revenue, keys=["e"], history=part.history)
        long = ops.channel_roas_summary(part.spend_long, part.revenue, keys=["e"],
                                        history=ops.unpivot_channels(part.history, keys=["e"]))
        assert [r["channel"] for r in moved.orderBy("e", "channel").collect()] == \
            [r["channel"] for r in long.orderBy("e", "channel").collect()]
        assert rows_of(moved.select("e", "channel", "attr_rev_30d")) == rows_of(long.select("e", "channel", "attr_rev_30d"))


def test_history_reads_only_the_months_it_needs(spark):
    root = tempfile.mkdtemp(prefix="spendlens-months-")
    save_prepared(feeds_of(spark), root)
    months = history_months(spark, root, "2023-11-05", 29, ["e"])
    # the resting entity adds the months before its rest, and no month between
    assert months[-1] == "2023-11" and {"2023-02", "2023-10"} <= set(months)
    assert not {"2023-04", "2023-05", "2023-06"} & set(months)
    part = load_prepared(spark, root, "2023-11-05", None, ["e"])
    assert {r["e"]: r["count"] for r in part.history.groupBy("e").count().collect()} == {"x": 29, None: 29}
    assert load_prepared(spark, root, "2023-01-01", None, ["e"]).history.count() == 0


# --------------------------------------------------------------------------- loads

def write_csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write("date,revenue,transactions,new_customers\n" + "".join(f"{r}\n" for r in rows))


def test_two_loads_equal_one(spark):
    root = tempfile.mkdtemp(prefix="spendlens-loads-")
    files = {"a": ["2023-01-01,1,1,1", "2023-01-01,2,2,2", "2023-01-03,3,3,3"],
             "b": ["2023-01-01,9,9,9", "2023-01-02,4,4,4", ",5,5,5"], "c": ["2023-01-02,8,8,8", ",6,6,6"], "d": []}
    for name, rows in files.items():
        write_csv(f"{root}/in/{name}.csv", rows)
    at_once = rows_of(prepare(Feeds(revenue=read_feed(spark, f"{root}/in", "revenue"))).revenue)
    assert [r[1] for r in at_once] == sorted([1, 3, 4, 5], key=lambda x: at_once.index(next(r for r in at_once if r[1] == x)))
    table = f"{root}/table"
    with pytest.raises(FileNotFoundError):
        arrivals.first_arrivals(spark, table)
    for name in ("c", "a", "d", "b", "a"):  # in any order, one of them twice
        arrivals.add_load(read_feed(spark, f"{root}/in/{name}.csv", "revenue"), table, name)
    kept = lambda: rows_of(arrivals.first_arrivals(spark, table).drop(INGEST_ORD))
    assert kept() == at_once and arrivals.loads(spark, table) == ["a", "b", "c", "d"]
    arrivals.compact(spark, table, "2023")
    assert kept() == at_once and arrivals.loads(spark, table) == ["2023"]
    write_csv(f"{root}/in/e.csv", ["2023-01-05,7,7,7", "2023-01-01,0,0,0"])
    arrivals.add_load(read_feed(spark, f"{root}/in/e.csv", "revenue"), table, "e")
    assert kept() == rows_of(prepare(Feeds(revenue=read_feed(spark, f"{root}/in", "revenue"))).revenue)
    for bad in ("", "a/b", "a=b", "_x", ".x"):
        with pytest.raises(ValueError):
            arrivals.add_load(read_feed(spark, f"{root}/in/e.csv", "revenue"), table, bad)


# ------------------------------------------------------------------- one read per feed

def test_quality_reports_of_counted_rows(spark):
    rows = [(0, [1, 2, 3, 4, 5, 6])] * 3 + [(i, [None, 2, 3, 4, 5, i]) for i in range(1, 12)] + \
        [(i, [1, 2, 3, 4, 5, 999]) for i in (20, 20, 20, 40)]
    s = spend_df(spark, rows)
    s = s.unionByName(s.limit(1).select(F.lit(None).cast("date").alias("date"), *COLS))
    counted = ops.counted_rows(s)
    assert counted.count() == 15
    assert rows_of(ops.repeated(counted).select(*s.columns)) == rows_of(s)
    assert rows_of(ops.null_profile({"t": counted})) == rows_of(ops.null_profile({"t": s}))
    assert rows_of(ops.date_gaps(counted)) == rows_of(ops.date_gaps(s))
    assert rows_of(ops.spend_outliers(counted, 0.5)) == rows_of(ops.spend_outliers(s, 0.5)) != []
    assert rows_of(ops.outliers(counted, COLS[5], 1.5).select(*s.columns)) == rows_of(ops.outliers(s, COLS[5], 1.5))
    assert rows_of(ops.duplicate_keys(counted)) == rows_of(ops.duplicate_keys(s)) != []
    many = spark.createDataFrame([("a", 25_003), ("b", 1), ("c", 0)], "v string, _copies long")
    assert {r["v"]: r["count"] for r in ops.repeated(many).groupBy("v").count().collect()} == {"a": 25_003, "b": 1}


def test_each_raw_feed_is_read_once_for_all_quality_reports(spark):
    root = tempfile.mkdtemp(prefix="spendlens-once-")
    for name, df in (("spend", spend_df(spark, [(i, [1, 2, 3, 4, 5, 6]) for i in range(9)])),
                     ("revenue", revenue_df(spark, [(i, 1) for i in range(9)])),
                     ("factors", factors_df(spark, [(i, 0, 0, 0, 1.0) for i in range(9)]))):
        df.write.parquet(f"{root}/{name}")
    p = prepare(Feeds(**{n: read_feed(spark, f"{root}/{n}", f, "parquet") for n, f in
                         (("spend", "marketing_spend"), ("revenue", "revenue"), ("factors", "external_factors"))}))
    counted = counted_feeds(p)
    assert [executed_scans(df) for df in counted.values()] == [{"spend": 1}, {"revenue": 1}, {"factors": 1}]
    from spendlens.session import cut
    kept = {n: cut(df) for n, df in counted.items()}
    for name in QUALITY:
        assert executed_scans(reports(p, kept)[name]()) == {}, name


@pytest.mark.parametrize("name", ["month_seasonality", "perf_weekend", "perf_promo", "null_profile", "top_bottom",
                                  "budget_reallocation", "attribution_windows"])
def test_raw_tables_are_scanned_once(spark, name):
    scans = executed_scans(entry.queries()[name](spark, SF001))
    assert scans == {"lineitem.parquet": 1, "orders.parquet": 1}, name


@pytest.mark.parametrize("name", ["revenue_lift", "corr_seasonality", "seasonality_buckets"])
def test_factors_and_revenue_share_the_orders(spark, name):
    assert executed_scans(entry.queries()[name](spark, SF001))["orders.parquet"] == 1


def test_first_orders_are_the_only_second_scan(spark):
    p = entry._prepared(spark, SF001, entry.BOTH)
    every = p.spend.join(p.revenue, "date").join(p.factors, "date")
    assert executed_scans(every) == {"lineitem.parquet": 1, "orders.parquet": 2}


# ------------------------------------------------------------------- published files

def test_published_values(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spendlens-pub-"), "Some_report.csv")
    rows = [("email", "2023-01", 11404707.338032238, 7, "398603.410000", dt.date(2023, 1, 2)),
            ("a b", 'say "hi"', 0.1, None, "5.000000", None), (None, "", 1e-5, 0, "-0.500000", D0),
            ("ünï", "x,y", 1e300, 2, None, D0), ("_x1", "1x", 123456789.0, 3, "10.000000", D0)]
    df = spark.createDataFrame(rows, "channel string, p string, v double, n int, m string, d date") \
        .withColumn("m", F.col("m").cast("decimal(24,6)")).orderBy(F.col("n").desc_nulls_last())
    write_published(df, path)
    want = ['"channel","p","v","n","m","d"',
            'email,"2023-01",11404707.338032238,7,398603.41,"2023-01-02"',
            '_x1,"1x",123456789.0,3,10.0,"2023-01-01"', '"ünï","x,y",1.0E300,2,,"2023-01-01"',
            ',"",0.00001,0,-0.5,"2023-01-01"', '"a b","say ""hi""",0.1,,5.0,']
    assert open(path, encoding="utf-8").read() == "\n".join(want) + "\n"
    write_published(df.limit(0), path)  # replaces the file
    assert open(path).read() == want[0] + "\n"
    assert os.listdir(os.path.dirname(path)) in (["Some_report.csv"], ["Some_report.csv", ".Some_report.csv.crc"],
                                                 [".Some_report.csv.crc", "Some_report.csv"])


def test_cli_writes_the_published_shape(spark):
    root = tempfile.mkdtemp(prefix="spendlens-shape-")
    f = driver_feeds(spark, SF001)
    for name in ("spend", "revenue", "factors"):
        getattr(f, name).drop(INGEST_ORD).write.option("header", True).csv(f"{root}/{name}")
    args = ["--spend", f"{root}/spend", "--revenue", f"{root}/revenue", "--factors", f"{root}/factors", "--out", f"{root}/out"]
    names = run(args, spark)
    files = sorted(n for n in os.listdir(f"{root}/out") if not n.startswith("."))
    assert len(files) == len(names) == 29 and all(n.endswith(".csv") for n in files)
    lines = open(f"{root}/out/Attribution_windows.csv").read().split("\n")
    assert lines[0] == '"channel","attribution_window_days","total_spend","total_revenue_attributed_k","roas_k"'
    channel, k, spend, revenue, roas = lines[1].split(",")
    assert channel in ("paid_search", "paid_social", "display", "email", "affiliate", "tv") and k == "7"
    for text in (spend, revenue, roas):
        assert "E" not in text and '"' not in text and float(text) > 0 and "." in text
    assert len(lines) == 20 and lines[-1] == ""
    assert open(f"{root}/out/Cohort_analysis.csv").read().split("\n")[1].split(",")[1].startswith('"199')
    with_real = run([*args[:-1], f"{root}/real", "--real", "--only", "attribution_windows,date_gaps"], spark)
    assert sorted(with_real) == ["attribution_windows", "date_gaps"]
    assert open(f"{root}/real/date_gaps.csv").read() == open(f"{root}/out/date_gaps.csv").read()
