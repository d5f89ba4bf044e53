"""Raw payloads to daily bars."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbar.schemas import FUND_EXCLUDED, FUND_HOUSES, FUND_REQUIRED


def decode_klines(df: DataFrame, payload: str = "payload", symbol: str = "symbol") -> DataFrame:
    """JSON array of ``[open_ms, open, high, low, close, volume, ...]`` to bars (UTC)."""
    rows = df.select(
        symbol, F.explode(F.from_json(payload, "array<array<string>>")).alias("_k")
    )
    names = ["open", "high", "low", "close", "volume"]
    return rows.select(
        F.col(symbol).alias("symbol"),
        F.timestamp_millis(F.get("_k", F.lit(0)).try_cast("long")).alias("event_time"),
        *[F.get("_k", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)],
    )


NAV_PAYLOAD = "struct<data:array<struct<date:string,nav:string>>>"


def decode_navs(
    df: DataFrame, code: str = "code", name: str = "name", payload: str = "payload"
) -> DataFrame:
    """Fund history JSON to bars: open = high = low = close = NAV, no volume.

    Entries with an unreadable date or value are skipped.
    """
    entries = df.select(
        F.concat(F.lit("MF"), F.col(code).cast("string")).alias("symbol"),
        F.col(name).alias("asset_name"),
        F.explode(F.from_json(payload, NAV_PAYLOAD)["data"]).alias("_e"),
    )
    nav = F.col("nav")
    return (
        entries.select(
            "symbol",
            "asset_name",
            F.to_date(F.try_to_timestamp(F.col("_e.date"), F.lit("dd-MM-yyyy"))).alias("event_time"),
            F.col("_e.nav").try_cast("double").alias("nav"),
        )
        .where(F.col("event_time").isNotNull() & nav.isNotNull())
        .select(
            "symbol",
            "asset_name",
            "event_time",
            nav.alias("open"),
            nav.alias("high"),
            nav.alias("low"),
            nav.alias("close"),
            F.lit(0.0).alias("volume"),
        )
    )


def fund_filter(
    name: Column,
    houses: Sequence[str] = FUND_HOUSES,
    required: Sequence[str] = FUND_REQUIRED,
    excluded: Sequence[str] = FUND_EXCLUDED,
) -> Column:
    """Any house (case-insensitive), every required word (exact), no excluded word."""
    lowered = F.lower(name)
    any_house = reduce(or_, [lowered.contains(k.lower()) for k in houses])
    all_words = reduce(and_, [name.contains(k) for k in required])
    banned = reduce(or_, [lowered.contains(k.lower()) for k in excluded])
    return any_house & all_words & ~banned


def select_funds(catalogue: DataFrame, name: str = "schemeName", **words) -> DataFrame:
    return catalogue.where(fund_filter(F.col(name), **words))


def constituents(df: DataFrame, suffix: str = ".NS") -> DataFrame:
    """Index members to tickers."""
    return df.select(F.concat(F.col("Symbol"), F.lit(suffix)).alias("ticker"))


def read_constituents(spark: SparkSession, path: str, suffix: str = ".NS") -> DataFrame:
    return constituents(spark.read.csv(path, header=True), suffix)


def normalise_ohlcv(df: DataFrame) -> DataFrame:
    """Drop rows without prices; no volume is 0; the name falls back to the symbol."""
    name = F.col("asset_name") if "asset_name" in df.columns else F.lit(None).cast("string")
    return df.dropna(subset=["open", "high", "low", "close"]).withColumns(
        {
            "volume": F.coalesce(F.col("volume").cast("double"), F.lit(0.0)),
            "asset_name": F.coalesce(name, F.col("symbol")),
        }
    )
