"""Panels over the order, line item and event tables.

Prices are divided by a prime, which puts them at the size of exchange rates
and keeps means off the ties of decimal rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_UNIT = 100003.0
BASE_KEY = "3-MEDIUM"
ROWS_PER_TASK = 125_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows: several orders a day per priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("key"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("o_totalprice") / PRICE_UNIT).alias("rate"),
    )


def panel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rates(spark, sf_dir).groupBy("key", "date").agg(F.avg("rate").alias("rate"))


def panel_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("key"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / PRICE_UNIT).alias("rate"),
    )
    return rows.groupBy("key", "date").agg(F.avg("rate").alias("rate"))


def panel_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with many keys. Its rows are dealt by key once, over as many tasks as their number asks for, and
    means and windows per key go on from there: what a task holds does not grow with the table."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // ROWS_PER_TASK))
    rows = lines.select(
        F.col("l_suppkey").cast("string").alias("key"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / PRICE_UNIT).alias("rate"),
    )
    return rows.repartition(tasks, "key").groupBy("key", "date").agg(F.avg("rate").alias("rate"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "ts", "value")
