"""Reading the test tables and deriving the session table from them.

One order is one session (FIXTURES.md section 2). The derivation is a
star join: per-order line aggregates (orders x lineitem, one row per order
on both sides) and per-customer facts (customer x first-two-orders, one row
per customer) joined to orders. The "first two orders of a customer" come from a
row number that Spark limits to two before the shuffle, so a customer that
owns a third of all orders is never sorted inside one task; the join of orders to
their customer is a plain equi-join, whose skewed side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ALL_FEATURES, KEY, TARGET

# fixed values: month names by month number 1..12
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "June", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: str) -> Column:
    """Nearest whole cent, halves up: floor(x * 100 + 0.5).

    Same value as ``round(x * 100)`` for amounts with at most two decimals
    (checked against ROUND in the SQL oracle) without a BigDecimal per row.
    """
    return F.floor(F.col(c) * 100 + 0.5).cast("bigint")


def order_line_facts(lineitem: DataFrame) -> DataFrame:
    """Per order: line counts and integer sums (partial + final aggregate)."""
    flag_a = F.col("l_returnflag") == "A"
    flag_n = F.col("l_returnflag") == "N"
    qty = F.col("l_quantity").cast("bigint")
    return lineitem.groupBy(F.col("l_orderkey")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(flag_a, 1)).alias("na"),
        F.count(F.when(flag_n, 1)).alias("nn"),
        F.sum(qty).alias("q"),
        F.sum(F.when(flag_a, qty)).alias("qa"),
        F.sum(F.when(flag_n, qty)).alias("qn"),
        F.sum(_cents("l_discount")).alias("d"),
        F.sum(_cents("l_tax")).alias("t"),
        F.sum(_cents("l_extendedprice")).alias("k"),
    )


def customer_facts(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Per customer: nation, segment and the second of its orders by (o_orderdate, o_orderkey).

    Only each customer's first two orders matter, so the row number is limited before
    the shuffle as well as after it: a customer with a third of
    all orders sends two rows a task.
    """
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    two = orders.select("o_custkey", "o_orderdate", "o_orderkey").withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    second = two.groupBy("o_custkey").agg(
        F.max(F.when(F.col("_rn") == 2, F.col("o_orderdate"))).alias("second_date"),
        F.max(F.when(F.col("_rn") == 2, F.col("o_orderkey"))).alias("second_key"))
    return (customer.select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(second.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left"))


def sessions_from_tables(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Derive the keyed session table (session_id + 17 features + Revenue)."""
    lines = order_line_facts(lineitem)
    cust = customer_facts(orders, customer)
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    j = (
        o.join(cust, o.o_custkey == cust.c_custkey, "inner")
        .join(lines, o.o_orderkey == lines.l_orderkey, "left")
    )
    early = F.col("second_key").isNull() | (F.col("o_orderdate") < F.col("second_date")) | (
        (F.col("o_orderdate") == F.col("second_date")) & (F.col("o_orderkey") <= F.col("second_key")))
    m = F.month("o_orderdate")
    dd = F.dayofmonth("o_orderdate")
    gap = F.abs(dd - 14)
    n_d = F.col("n").cast("double")
    month_names = F.array(*[F.lit(x) for x in MONTH_NAMES])
    key = F.col("o_orderkey")
    return j.select(
        key.alias(KEY),
        F.coalesce(F.col("na"), F.lit(0)).cast("int").alias("Administrative"),
        F.coalesce(F.col("qa"), F.lit(0)).cast("double").alias("Administrative_Duration"),
        F.coalesce(F.col("nn"), F.lit(0)).cast("int").alias("Informational"),
        F.coalesce(F.col("qn"), F.lit(0)).cast("double").alias("Informational_Duration"),
        F.coalesce(F.col("n"), F.lit(0)).cast("int").alias("ProductRelated"),
        F.coalesce(F.col("q"), F.lit(0)).cast("double").alias("ProductRelated_Duration"),
        (F.col("d").cast("double") / n_d / 100).alias("BounceRates"),
        ((F.col("d") + F.col("t")).cast("double") / n_d / 100).alias("ExitRates"),
        (F.col("k").cast("double") / 1000000).alias("PageValues"),
        F.when(m.isin(2, 5) & (gap < 5), (F.lit(5) - gap).cast("double") / 5).otherwise(F.lit(0.0)).alias("SpecialDay"),
        F.element_at(month_names, m).alias("Month"),
        F.when((F.col("c_mktsegment") == "MACHINERY") & (key % 3 == 0), F.lit("Other"))
        .when(early, F.lit("New_Visitor"))
        .otherwise(F.lit("Returning_Visitor"))
        .alias("VisitorType"),
        (F.lit(1) + key % 8).cast("int").alias("OperatingSystems"),
        (F.lit(1) + F.col("o_custkey") % 13).cast("int").alias("Browser"),
        (F.lit(1) + F.col("c_nationkey") % 9).cast("int").alias("Region"),
        (F.lit(1) + key % 20).cast("int").alias("TrafficType"),
        F.dayofweek("o_orderdate").isin(1, 7).alias("Weekend"),
        (((F.coalesce(F.col("k"), F.lit(0)) >= 30000000) & (key % 10 < 5)) | (key % 29 == 0)).alias(TARGET),
    )


def load_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session table derived from ``orders``, ``customer`` and ``lineitem``."""
    return sessions_from_tables(
        read_table(spark, sf_dir, "orders"),
        read_table(spark, sf_dir, "customer"),
        read_table(spark, sf_dir, "lineitem"),
    )


SESSION_COLUMNS = [KEY] + ALL_FEATURES + [TARGET]
