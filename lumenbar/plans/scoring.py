"""Batch scoring: latest features of every symbol to signals with risk columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbar.functions.scoring import signal_label, with_risk_columns
from lumenbar.operators.merge import replace_rows
from lumenbar.operators.panel import latest_per
from lumenbar.plans.serving import conform_signals
from lumenbar.schemas import FEATURES
from lumenbar.sources.versioned import Manifest, VersionedTable

Scorer = Callable[[DataFrame, str], DataFrame]


def eligible_latest(features: DataFrame) -> DataFrame:
    """Latest row per symbol among rows with RSI and both long averages."""
    usable = features.dropna(subset=["rsi_14", "sma_50", "sma_200"])
    return latest_per(usable, ["symbol"], ["event_time"])


def column_scorer(prob: Column) -> Scorer:
    """A scorer that uses a column expression as the probability."""
    return lambda df, out: df.withColumn(out, prob)


def signals_from_scores(scored: DataFrame, p1y: str = "_p1y", p5y: str = "_p5y") -> DataFrame:
    """Labels, confidences and risk columns; the plain label is the one-year label."""
    labelled = scored.withColumns(
        {
            "trade_date": F.to_date("event_time"),
            "signal_1y": signal_label(F.col(p1y), "1y"),
            "confidence_1y": F.col(p1y),
            "signal_5y": signal_label(F.col(p5y), "5y"),
            "confidence_5y": F.col(p5y),
        }
    ).withColumns({"signal": F.col("signal_1y"), "confidence": F.col("confidence_1y")})
    return conform_signals(with_risk_columns(labelled, p1y, p5y))


def generate_signals(
    features: DataFrame,
    score_1y: Scorer,
    score_5y: Scorer,
    existing: DataFrame | None = None,
    model_features: list[str] | None = None,
) -> DataFrame:
    """Scores the latest eligible rows and merges them into the existing signal table.

    Base features are filled with 0 where missing, and the risk formulas see the filled
    values; a trained artifact fills whatever other features it has by itself.
    """
    names = [c for c in (model_features or FEATURES) if c in features.columns]
    latest = eligible_latest(features).fillna(0.0, subset=names)
    fresh = signals_from_scores(score_5y(score_1y(latest, "_p1y"), "_p5y"))
    if existing is None:
        return fresh
    return replace_rows(existing, fresh, ["symbol", "trade_date"])


def write_signals(
    features: DataFrame,
    score_1y: Scorer,
    score_5y: Scorer,
    target: VersionedTable,
    model_features: list[str] | None = None,
) -> Manifest | None:
    """Scores the latest rows and merges them into the stored signals of their days.

    Only the days of the new signals are read and rewritten; a signal of a stored symbol and
    day is replaced, and columns that earlier runs did not have are added.
    """
    fresh = generate_signals(features, score_1y, score_5y, model_features=model_features)
    return target.merge(fresh, ["symbol", "trade_date"], ["trade_date"])
