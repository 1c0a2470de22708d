"""The driver's test tables as the engine's data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bars before this date are the library market, those from it on the target market.
MARKET_SPLIT = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(trades: DataFrame, symbol: Column, day: Column, price: Column, quantity: Column, order: list[Column]) -> DataFrame:
    """``symbol, trade_date, open, high, low, close, volume`` of trades.

    First and last go by ``order``, then by price, so the result doesn't depend on the order of rows. Trades without
    a price are ignored; a day without any has no bar.
    """
    priced = trades.select(symbol.alias("symbol"), day.alias("trade_date"), price.alias("price"), quantity.alias("quantity"), F.struct(*order, price).alias("at")).filter("price IS NOT NULL")
    return priced.groupBy("symbol", "trade_date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"), F.sum("quantity").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a supplier's line items by ship date, priced per unit."""
    c = F.col
    # a supplier has hardly two line items a day, so they are dealt by supplier at once: windows and recursions that follow need no shuffle
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber").repartition("l_suppkey")
    return daily_bars(
        items, c("l_suppkey"), F.to_date("l_shipdate"), F.try_divide(c("l_extendedprice"), c("l_quantity")),
        c("l_quantity"), [c("l_orderkey"), c("l_linenumber")],
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades in their supplier: what closes and volumes of ``bars`` are made of."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), c("l_extendedprice").alias("amount"), c("l_quantity").alias("quantity"),
        c("l_orderkey").alias("major"), c("l_linenumber").alias("minor"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as ticks: ``symbol, timestamp, price, volume, event_id``."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"), F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"), "event_id")


def market(trade_date: Column) -> Column:
    return F.when(trade_date < F.lit(MARKET_SPLIT).cast("date"), "lib").otherwise("tgt")


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price of each nation's customers by month: ``symbol, trade_date, close``."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_nationkey").cast("long").alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("trade_date")).agg(F.avg("o_totalprice").alias("close"))
