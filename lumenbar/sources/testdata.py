"""Panels derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _trade_order() -> Column:
    """(order, line, price in cents, quantity) packed into one decimal.

    Equal keys have equal prices, so open and close are well defined, and a decimal
    (unlike a struct) keeps the aggregation on the hash path.
    """
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    detail = F.round(F.col("l_extendedprice") * 100).cast("long") * 1000 + F.col(
        "l_quantity"
    ).cast("long")
    return line.cast("decimal(20,0)") * F.lit(10**15).cast("decimal(16,0)") + detail


def bars(spark: SparkSession, folder: str, symbol: str = "p_brand") -> DataFrame:
    """Daily OHLCV bars: one series per value of a part column, one bar per ship date.

    The join side is left to the size statistics and AQE (broadcast when small,
    skew-split sort-merge otherwise); all five aggregates combine in the map tasks.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_partkey",
        "l_quantity",
        F.to_date("l_shipdate").alias("event_time"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        _trade_order().alias("k"),
    )
    parts = table(spark, folder, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("symbol", "event_time")
        .agg(
            F.min_by("px", "k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def logistic_score(rsi: Column) -> Column:
    """Deterministic stand-in for a model probability."""
    return 1.0 / (1.0 + F.exp(-(rsi - 50.0) / 10.0))


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events table read as an audit log: one task run per event."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(kind == "signup", "PARTIAL").otherwise("SUCCESS")
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("audit_id"),
        kind.alias("job"),
        F.col("ts").alias("start_time"),
        status.alias("status"),
        F.col("value").alias("duration_seconds"),
        F.col("user_id").alias("rows_inserted"),
        (F.col("user_id") % 7).alias("rows_updated"),
        (F.col("user_id") % 3).alias("rows_deleted"),
    )
