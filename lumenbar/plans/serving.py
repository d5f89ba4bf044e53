"""Queries a user or dashboard calls on the signal and feature tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbar.functions.formatting import (
    band_state,
    display_name,
    label_rank,
    macd_state,
    outlook_text,
    price_text,
    rsi_state,
    trend_state,
)
from lumenbar.operators.panel import latest_per
from lumenbar.schemas import ACTIONABLE, SIGNAL_SCHEMA
from lumenbar.sources.tables import available, column_or

CONFIDENCES = ["confidence_1y", "confidence_5y", "combined_confidence"]
# Columns of the API result, in order (the plain label and confidence are left out).
API_COLUMNS = [
    "symbol",
    "trade_date",
    "signal_1y",
    "confidence_1y",
    "signal_5y",
    "confidence_5y",
    "combined_confidence",
    "risk_bucket",
    "risk_score",
    "suggested_position_pct",
    "expected_return_1y",
    "risk_adjusted_score",
    "var_95_1d",
    "cvar_95_1d",
]
RISK_COLUMNS = [
    "combined_confidence",
    "risk_bucket",
    "risk_score",
    "suggested_position_pct",
    "expected_return_1y",
    "risk_adjusted_score",
    "var_95_1d",
    "cvar_95_1d",
]


def min_confidence_filter(df: DataFrame, least: float) -> Column:
    """Any existing confidence column reaches ``least``; true when none exists."""
    present = available(df, CONFIDENCES)
    if not present:
        return F.lit(True)
    return reduce(or_, [F.col(c) >= least for c in present])


def api_signals(signals: DataFrame, limit: int = 50, min_confidence: float = 0.0) -> DataFrame:
    """Filter first, then the latest row per symbol, by symbol, at most ``limit`` rows."""
    kept = signals.where(min_confidence_filter(signals, min_confidence))
    newest = latest_per(kept.select(*available(kept, API_COLUMNS)), ["symbol"], ["trade_date"])
    return newest.orderBy("symbol").limit(limit)


def latest_signals_with_features(signals: DataFrame, features: DataFrame) -> DataFrame:
    """Latest signal joined to latest features; one row per symbol on both sides."""
    name = display_name(column_or(features, "asset_name", F.lit(None).cast("string")), F.col("symbol"))
    picked = latest_per(features, ["symbol"], ["event_time"]).select(
        "symbol",
        name.alias("asset_name"),
        *available(features, ["close", "rsi_14", "volatility_7d", "atr_14"]),
    )
    return latest_per(signals, ["symbol"], ["trade_date"]).join(picked, "symbol")


def opportunities(signals: DataFrame, features: DataFrame) -> DataFrame:
    """Actionable latest signals, ranked by the best score column present."""
    joined = latest_signals_with_features(signals, features)
    labels = available(joined, ["signal", "signal_1y", "signal_5y"])
    actionable = reduce(or_, [F.col(c).isin(*ACTIONABLE) for c in labels], F.lit(False))
    kept = joined.where(F.coalesce(actionable, F.lit(False)))
    ranking = available(kept, ["risk_adjusted_score", "confidence_1y", "confidence"])
    if ranking:
        kept = kept.orderBy(F.col(ranking[0]).desc_nulls_last(), "symbol")
    columns = ["asset_name"]
    for suffix in ("_1y", "_5y", ""):
        pair = [f"signal{suffix}", f"confidence{suffix}"]
        if len(available(kept, pair)) == 2:
            columns += pair
    columns += available(
        kept, [*RISK_COLUMNS, "close", "rsi_14", "volatility_7d", "atr_14"]
    )
    return kept.select(*columns)


def market_overview(
    signals: DataFrame,
    features: DataFrame,
    horizon: str = "1y",
    prefix: str = "$",
    suffix: str = "",
) -> DataFrame:
    """Formatted overview per symbol, strongest label first, then highest confidence."""
    label, prob = f"signal_{horizon}", f"confidence_{horizon}"
    if label not in signals.columns:
        label, prob = "signal", "confidence"
    joined = latest_signals_with_features(signals, features)
    return (
        joined.orderBy(label_rank(F.col(label)), F.col(prob).desc_nulls_last(), "symbol")
        .select(
            "symbol",
            "asset_name",
            outlook_text(F.col(label), F.col(prob)).alias("outlook"),
            price_text(F.col("close"), prefix, suffix).alias("price"),
            F.round("rsi_14", 1).alias("rsi_14"),
            F.round("volatility_7d", 2).alias("volatility_7d"),
        )
    )


def technical_context(features: DataFrame, prefix: str = "$", suffix: str = "") -> DataFrame:
    """Latest facts per symbol as labels and a text note."""
    last = latest_per(features, ["symbol"], ["event_time"])
    close = F.col("close")

    def money(c: str) -> Column:
        return price_text(F.col(c), prefix, suffix)

    trend = F.concat(
        F.lit("Trend: "),
        trend_state(close, F.col("ema_20")),
        F.lit(" (price "),
        money("close"),
        F.when(close > F.col("ema_20"), " above").otherwise(" below"),
        F.lit(" the 20-day EMA "),
        money("ema_20"),
        F.lit(")"),
    )
    momentum = F.concat(
        F.lit("Momentum: "),
        rsi_state(F.col("rsi_14")),
        F.format_string(" (RSI %.1f)", F.col("rsi_14")),
    )
    breakout = F.when(
        close > F.col("bb_upper"), F.concat(F.lit("Volatility: above "), money("bb_upper"))
    ).when(close < F.col("bb_lower"), F.concat(F.lit("Volatility: below "), money("bb_lower")))
    return last.select(
        "symbol",
        "event_time",
        trend_state(close, F.col("ema_20")).alias("trend"),
        rsi_state(F.col("rsi_14")).alias("momentum"),
        macd_state(F.col("macd"), F.col("macd_signal")).alias("crossover"),
        band_state(close, F.col("bb_upper"), F.col("bb_lower")).alias("bands"),
        F.concat_ws("; ", trend, momentum, breakout).alias("note"),
    )


def conform_signals(df: DataFrame) -> DataFrame:
    """Signal rows in the column order and types of the gold table."""
    return df.select(
        *[column_or(df, f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SIGNAL_SCHEMA]
    )
