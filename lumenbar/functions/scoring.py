"""Probability -> label and the risk columns of a scored signal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbar.functions.nulls import clip, default_if_falsy
from lumenbar.schemas import PHI_Z_95, SIGNAL_THRESHOLDS, TAIL_95, Z_95


def signal_label(prob: Column, horizon: str) -> Column:
    """First label whose lower bound the probability reaches; the lowest label otherwise."""
    table = SIGNAL_THRESHOLDS[horizon]
    chain = F.when(prob >= table[0][0], table[0][1])
    for bound, label in table[1:]:
        chain = chain.when(prob >= bound, label)
    return chain.otherwise(table[-1][1])


def with_risk_columns(df: DataFrame, p1y: str, p5y: str) -> DataFrame:
    """Adds confidence, risk, sizing and tail-loss columns.

    Inputs: close, volatility_7d, atr_14, rsi_14, sma_50, sma_200 and two
    probabilities. A NULL or 0 input takes its default (50 for RSI, 0 for others).
    """
    close = default_if_falsy(F.col("close"), 0.0)
    vol = default_if_falsy(F.col("volatility_7d"), 0.0)
    atr = default_if_falsy(F.col("atr_14"), 0.0)
    rsi = default_if_falsy(F.col("rsi_14"), 50.0)
    fast = default_if_falsy(F.col("sma_50"), 0.0)
    slow = default_if_falsy(F.col("sma_200"), 0.0)

    # One projection per dependency level, so no expression is repeated in the plan.
    base = df.withColumns(
        {
            "_vol": vol,
            "_atr_pct": F.when(close > 0, F.try_divide(atr, close)).otherwise(1.0),
            "_rsi_gap": F.abs(rsi - 50.0) / 50.0,
            "_trend": F.when(slow != 0, F.try_divide(fast - slow, F.abs(slow))).otherwise(0.0),
            "combined_confidence": clip(0.65 * F.col(p1y) + 0.35 * F.col(p5y), 0.0, 1.0),
        }
    )
    risk = base.withColumn(
        "_risk",
        clip(
            0.40 * clip(F.col("_vol") / 0.06, 0.0, 1.0)
            + 0.30 * clip(F.col("_atr_pct") / 0.08, 0.0, 1.0)
            + 0.15 * clip(F.col("_rsi_gap"), 0.0, 1.0)
            + 0.15 * clip(-F.col("_trend") / 0.30, 0.0, 1.0),
            0.0,
            1.0,
        ),
    )
    p, r = F.col("combined_confidence"), F.col("_risk")
    conviction = clip((p - 0.50) / 0.50, 0.0, 1.0)
    sized = risk.withColumns(
        {
            "risk_score": r * 100.0,
            "risk_bucket": F.when(r * 100.0 < 35, "LOW")
            .when(r * 100.0 < 65, "MEDIUM")
            .otherwise("HIGH"),
            "suggested_position_pct": clip(
                0.01 + 0.11 * conviction * (1 - 0.75 * r), 0.01, 0.12
            ),
            "expected_return_1y": p * 0.10 - (1.0 - p) * 0.06,
            "_sigma": clip(
                F.greatest("_vol", F.col("_atr_pct") / math.sqrt(14.0), F.lit(1e-4)), 1e-4, 0.50
            ),
        }
    )
    daily = F.col("expected_return_1y") / 252.0
    tails = sized.withColumns(
        {
            "risk_adjusted_score": F.col("expected_return_1y") * (1.0 - r),
            "_var": F.greatest(F.lit(0.0), Z_95 * F.col("_sigma") - daily),
            "_es": F.greatest(F.lit(0.0), F.col("_sigma") * (PHI_Z_95 / TAIL_95) - daily),
        }
    )
    size = F.col("suggested_position_pct")
    return tails.withColumns(
        {
            "var_95_1d": clip(F.col("_var") * size, 0.0, 1.0),
            "cvar_95_1d": clip(F.greatest("_es", "_var") * size, 0.0, 1.0),
        }
    ).drop("_vol", "_atr_pct", "_rsi_gap", "_trend", "_risk", "_sigma", "_var", "_es")
