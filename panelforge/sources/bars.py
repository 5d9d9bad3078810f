"""Price bars (date, ticker, open, high, low, close, volume) out of event, order and trade tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["date", "ticker", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars(ticks: DataFrame, date: Column, ticker: Column, price: Column, order: Column) -> DataFrame:
    """One bar per ticker and date: first and last price by `order`, extremes and the number of ticks."""
    t = ticks.select(date.cast("date").alias("date"), ticker.alias("ticker"), price.cast("double").alias("p"), order.alias("o")).where("date IS NOT NULL AND ticker IS NOT NULL AND p IS NOT NULL AND NOT isnan(p)")
    return t.groupBy("date", "ticker").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count("*").alias("volume"))


def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of event values by type."""
    return bars(table(spark, folder, "events"), F.col("ts"), F.col("event_type"), F.col("value"), F.struct("ts", "event_id"))


def order_bars(spark: SparkSession, folder: str, grain: str = "week") -> DataFrame:
    """Bars of order totals by priority; grain: day, week or month."""
    return bars(table(spark, folder, "orders"), F.date_trunc(grain, "o_orderdate"), F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderkey"))


def nation_bars(spark: SparkSession, folder: str, grain: str = "month") -> DataFrame:
    """Bars of order totals by the customer's nation."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    home = table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(table(spark, folder, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return bars(orders.join(home, F.col("o_custkey") == F.col("c_custkey")), F.date_trunc(grain, "o_orderdate"), F.col("n_name"), F.col("o_totalprice"), F.col("o_orderkey"))


def nation_sectors(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, sector): a nation's region."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))


def dirty_bars(prices: DataFrame, key: DataFrame | None = None) -> DataFrame:
    """Bars with faults planted by a hash of their day: negative closes, crossed extremes, negative volumes."""
    k = F.datediff("date", F.lit("1990-01-01").cast("date"))
    return prices.select(
        "date", "ticker", "open",
        F.when(k % 11 == 3, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low",
        F.when(k % 13 == 5, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(k % 17 == 7, F.lit(-1).cast("long")).otherwise(F.col("volume")).alias("volume"),
    )
