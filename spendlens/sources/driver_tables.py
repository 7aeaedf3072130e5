"""Map the generic star-schema test tables onto the three daily feeds.

The mapping (one row per date in each feed):

* spend: ``lineitem`` by ship date; each channel is the extended price of one
  (return flag, line status) pair, 0 when the pair has no line that day.
* revenue: ``orders`` by order date; total price, order count, and the number of orders
  that are their customer's first by (order date, order key).
* factors: dates present in both tables; weekend and fixed holidays from the calendar,
  promotion when the mean discount exceeds 5%, competitor index = mean tax,
  seasonality = the day's share of orders times the number of order dates.

Every aggregate is a plain ``groupBy`` (partial aggregation before the shuffle), so one
hot date or customer costs one row per task, not one task. Money is summed as exact
integer cents and turned into DECIMAL(18,2) once per output row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.columns import cents, from_cents
from spendlens.functions.shared import whole
from spendlens.sources.feeds import INGEST_ORD, Feeds
from spendlens.sources.schemas import spend_columns

# Fixed values: (return flag, line status) pair feeding each channel, in channel order.
CHANNEL_FLAGS = (("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O"))

# Month-day of the calendar holidays.
HOLIDAYS = ("01-01", "05-01", "12-24", "12-25", "12-26", "12-31")



# Declared read schemas (only the columns the mapping reads): no footer sampling at planning
# time, and the scan reads just these columns.
TABLE_SCHEMAS = {
    "lineitem": T.StructType([
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "supplier": T.StructType([
        T.StructField("s_suppkey", T.LongType()),
        T.StructField("s_nationkey", T.IntegerType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_nationkey", T.IntegerType()),
    ]),
    "nation": T.StructType([
        T.StructField("n_nationkey", T.IntegerType()),
        T.StructField("n_regionkey", T.IntegerType()),
    ]),
    "region": T.StructType([
        T.StructField("r_regionkey", T.IntegerType()),
        T.StructField("r_name", T.StringType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


_table = read_table


def _spend_sums() -> list:
    return [
        from_cents(F.coalesce(
            F.sum(F.when((F.col("l_returnflag") == rf) & (F.col("l_linestatus") == ls), F.col("price"))),
            F.lit(0),
        )).alias(col)
        for col, (rf, ls) in zip(spend_columns(), CHANNEL_FLAGS)
    ]


def lines_by_day(lineitem: DataFrame) -> DataFrame:
    """One row per ship date: spend by channel, lines, and discounts and taxes in hundredths."""
    li = lineitem.select(F.to_date("l_shipdate").alias("date"), "l_returnflag", "l_linestatus",
                         cents("l_extendedprice").alias("price"), cents("l_discount").alias("discount"),
                         cents("l_tax").alias("tax"))
    return li.groupBy("date").agg(*_spend_sums(), F.count(F.lit(1)).alias("n_lines"),
                                  F.sum("discount").alias("disc"), F.sum("tax").alias("tax"))


def orders_by_day(orders: DataFrame) -> DataFrame:
    """One row per order date: revenue and number of orders."""
    return orders.select(F.to_date("o_orderdate").alias("date"), cents("o_totalprice").alias("price")) \
        .groupBy("date").agg(from_cents(F.sum("price")).alias("revenue"), F.count(F.lit(1)).alias("n_orders"))


def spend_of(lines: DataFrame) -> DataFrame:
    return lines.select("date", *spend_columns(), F.unix_date("date").cast("bigint").alias(INGEST_ORD))


def revenue_of(by_day: DataFrame, orders: DataFrame) -> DataFrame:
    # The customer's first order by (order date, order key) is on the customer's earliest
    # order date, so min(date) per customer is enough: a hash aggregate with partial
    # aggregation (a min over a struct would plan as a sort-based aggregate), and a
    # customer with a huge order history still ships one row per task.
    firsts = (orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
              .groupBy(F.to_date("first").alias("date"))
              .agg(F.count(F.lit(1)).alias("new_customers")))
    return (by_day.join(firsts, "date", "left")
            .select("date", "revenue", F.col("n_orders").alias("transactions"),
                    F.coalesce("new_customers", F.lit(0)).cast("bigint").alias("new_customers"),
                    F.unix_date("date").cast("bigint").alias(INGEST_ORD)))


def factors_of(lines: DataFrame, by_day: DataFrame) -> DataFrame:
    li, od = lines.select("date", "n_lines", "disc", "tax"), by_day.select("date", "n_orders")
    # Two scalars over the per-date table (one row, executed once as a subquery).
    all_days = od.select(F.struct(F.count(F.lit(1)).alias("dates"), F.sum("n_orders").alias("orders"))).scalar()
    d = F.col("date")
    return (od.join(li, "date").select(
        "date",
        F.when(F.dayofweek(d).isin(1, 7), 1).otherwise(0).alias("is_weekend"),
        F.when(F.date_format(d, "MM-dd").isin(*HOLIDAYS), 1).otherwise(0).alias("is_holiday"),
        # mean discount above 0.05, compared exactly in cents: disc > 5 * lines
        F.when(F.col("disc") > F.col("n_lines") * 5, 1).otherwise(0).alias("promotion_active"),
        ((F.col("tax") / F.lit(100.0)) / F.col("n_lines")).alias("competitor_index"),
        ((F.col("n_orders") * all_days.getField("dates")).cast("double") / all_days.getField("orders").cast("double"))
        .alias("seasonality_index"),
        F.unix_date(d).cast("bigint").alias(INGEST_ORD),
    ))


def driver_feeds(spark: SparkSession, sf_dir: str, share: tuple = ()) -> Feeds:
    """The three feeds, each built on first use (a query planning one feed analyses one).

    ``share`` names the tables ("lineitem", "orders") that several feeds of a query read: their daily aggregate then
    has all columns and is made once. Without it, a feed reads only the columns it needs.
    """
    def lines():
        made = lines_by_day(_table(spark, sf_dir, "lineitem"))
        return whole(made) if "lineitem" in share else made

    def by_day():
        made = orders_by_day(_table(spark, sf_dir, "orders"))
        return whole(made) if "orders" in share else made

    return Feeds(spend=lambda: spend_of(lines()),
                 revenue=lambda: revenue_of(by_day(), _table(spark, sf_dir, "orders")),
                 factors=lambda: factors_of(lines(), by_day()))


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, region): the fixed 25-row nation dimension, so it is broadcast."""
    n = _table(spark, sf_dir, "nation")
    r = _table(spark, sf_dir, "region")
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                       .select("n_nationkey", F.col("r_name").alias("region")))


def region_feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    """Spend and revenue per (region, date): one entity key for the multi-entity operators.

    Spend takes the supplier's region, revenue the customer's. Supplier and customer grow
    with the data, so their joins are left to the planner (broadcast only when AQE measures
    them small); only the nation -> region dimension is hinted.
    """
    def spend():
        # Fact first with its growing dimension, then the fixed 25-row nation dimension: joining
        # supplier with nation first makes the planner's size estimate (a product of inputs
        # without statistics) exceed lineitem's, and lineitem would become the broadcast side.
        li = (_table(spark, sf_dir, "lineitem")
              .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
              .join(nation_regions(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
              .select("region", F.to_date("l_shipdate").alias("date"), "l_returnflag", "l_linestatus",
                      cents("l_extendedprice").alias("price")))
        return (li.groupBy("region", "date").agg(*_spend_sums())
                .withColumn(INGEST_ORD, F.unix_date("date").cast("bigint")))

    def revenue():
        o = (_table(spark, sf_dir, "orders")
             .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .join(nation_regions(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
             .select("region", "o_custkey", "o_orderdate", F.to_date("o_orderdate").alias("date"),
                     cents("o_totalprice").alias("price")))
        daily = o.groupBy("region", "date").agg(from_cents(F.sum("price")).alias("revenue"),
                                                F.count(F.lit(1)).alias("transactions"))
        firsts = (o.groupBy("region", "o_custkey").agg(F.min("o_orderdate").alias("first"))
                  .groupBy("region", F.to_date("first").alias("date"))
                  .agg(F.count(F.lit(1)).alias("new_customers")))
        return (daily.join(firsts, ["region", "date"], "left")
                .select("region", "date", "revenue", "transactions",
                        F.coalesce("new_customers", F.lit(0)).cast("bigint").alias("new_customers"),
                        F.unix_date("date").cast("bigint").alias(INGEST_ORD)))

    return Feeds(spend=spend, revenue=revenue)


def event_spend_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, long-form channel set: the day's summed event value per event type."""
    ev = _table(spark, sf_dir, "events")
    return (ev.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("channel"))
            .agg(from_cents(F.sum(cents("value"))).alias("spend")))
