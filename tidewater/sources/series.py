"""Series tables made from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Priorities of orders that count as promoted.
PROMOTED = ("1-URGENT", "2-HIGH")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, dt, sales, customers, promo: one series a nation, one row a day with orders.

    Money is added up in whole cents, so sums do not depend on their order.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("long").alias("store"), F.col("o_orderdate").cast("date").alias("dt"))
        .agg((cents / 100.0).alias("sales"), F.countDistinct("o_custkey").alias("customers"), F.max(F.col("o_orderpriority").isin(*PROMOTED).cast("int")).cast("long").alias("promo"))
    )


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales_daily as a raw fact table: some sales, flags and texts are missing, some days closed, by a fixed rule."""
    k = F.col("store") * 31 + F.dayofyear("dt")
    return sales_daily(spark, sf_dir).select(
        "store",
        "dt",
        F.when(k % 17 != 0, F.col("sales")).alias("sales"),
        F.when(k % 13 == 0, 0).when(k % 29 != 0, 1).cast("long").alias("open"),
        "promo",
        F.when(k % 19 != 0, F.month("dt").isin(7, 8).cast("long")).alias("school_holiday"),
        F.when(k % 11 == 0, None).when(k % 7 == 0, "a").when(k % 5 == 0, "b").otherwise("0").alias("state_holiday"),
        "customers",
    )


def store_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, store_name, region, competition (a double with gaps): one row a nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("store"), F.col("n_name").alias("store_name"), F.col("r_name").alias("region"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") * 10.0).alias("competition")
    )


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, ts (hour), target (events), amount (sum of value in thousandths): one series an event type."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return events.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", F.col("ts")).alias("ts")).agg(F.count("*").cast("double").alias("target"), (F.sum(F.round(F.col("value") * 1000).cast("long")) / 1000.0).alias("amount"))


def indexed(df: DataFrame, key: str = "store", order: str = "dt") -> DataFrame:
    """Adds idx: the 0-based place of each row in its series. Every later operator goes by it."""
    return df.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
