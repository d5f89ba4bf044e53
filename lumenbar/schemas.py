"""Schemas, feature lists and rule tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

# --- Fixed values: they define the results and must stay as they are. -------------

FEATURES = [
    "rsi_14",
    "volatility_7d",
    "macd",
    "macd_signal",
    "ema_20",
    "moving_avg_7d",
    "bb_upper",
    "bb_lower",
    "sma_50",
    "sma_200",
    "atr_14",
    "stoch_k",
    "stoch_d",
]

NAV_FEATURES = [
    "rolling_return_30d",
    "rolling_return_90d",
    "sortino_30d",
    "max_drawdown_30d",
    "nav_momentum_14d",
]

# Lower bound of the probability -> label, highest first.
SIGNAL_THRESHOLDS = {
    "1y": [
        (0.72, "INVEST NOW"),
        (0.58, "ACCUMULATE"),
        (0.42, "MONITOR"),
        (0.25, "WAIT"),
        (0.00, "AVOID"),
    ],
    "5y": [
        (0.70, "STRONG HOLD"),
        (0.55, "ACCUMULATE"),
        (0.40, "MONITOR"),
        (0.20, "WAIT"),
        (0.00, "AVOID"),
    ],
}

ACTIONABLE = ["INVEST NOW", "ACCUMULATE", "STRONG BUY", "BUY"]

LABEL_TEXT = {
    "INVEST NOW": "🚀 INVEST NOW",
    "ACCUMULATE": "✅ ACCUMULATE",
    "STRONG HOLD": "💎 STRONG HOLD",
    "MONITOR": "👀 MONITOR",
    "WAIT": "⏸ WAIT",
    "AVOID": "🔴 AVOID",
    "STRONG BUY": "🚀 STRONG BUY",
    "BUY": "✅ BUY",
    "HOLD": "⏸ HOLD",
    "SELL": "⚠️ SELL",
    "STRONG SELL": "🔴 STRONG SELL",
}

LABEL_RANK = {
    "INVEST NOW": 0,
    "STRONG HOLD": 0,
    "ACCUMULATE": 1,
    "MONITOR": 2,
    "WAIT": 3,
    "AVOID": 4,
    "STRONG BUY": 0,
    "BUY": 1,
    "HOLD": 2,
    "SELL": 3,
    "STRONG SELL": 4,
}

FUND_HOUSES = [
    "SBI",
    "ICICI Prudential",
    "HDFC",
    "Nippon India",
    "Kotak",
    "Axis",
    "Mirae Asset",
    "UTI",
    "DSP",
    "Tata",
    "Franklin India",
    "Canara Robeco",
    "PGIM India",
    "Sundaram",
    "Motilal Oswal",
    "Bandhan",
    "Edelweiss",
    "Aditya Birla Sun Life",
    "Quant",
    "WhiteOak Capital",
    "Parag Parikh",
    "Invesco India",
    "Navi",
]
FUND_REQUIRED = ["Direct", "Growth"]
FUND_EXCLUDED = ["IDCW", "Dividend", "Weekly", "Monthly", "Bonus", "Segregated"]

Z_95 = 1.6448536269514722
TAIL_95 = 0.05
PHI_Z_95 = math.exp(-0.5 * Z_95**2) / math.sqrt(2.0 * math.pi)

BUCKET_EDGES = [0.0, 0.40, 0.50, 0.60, 0.70, 0.80, 1.00]
SWEEP_THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70]
REGIMES = ["bull", "bear", "sideways"]
BULL_RETURN = 0.002
BEAR_RETURN = -0.002

MODEL_NAMES = ["histgb", "rf", "logreg"]

REPORT_ARTIFACTS = [
    "walk_forward_summary.json",
    "walk_forward_splits.csv",
    "walk_forward_buckets.csv",
    "walk_forward_thresholds.csv",
    "walk_forward_model_compare.csv",
    "walk_forward_regimes.csv",
    "walk_forward_drift.csv",
]

INGEST_START_DATE = "2016-01-01"

# --- End of fixed values. ---------------------------------------------------------


@dataclass(frozen=True)
class Horizon:
    name: str
    bars_ahead: int
    gain: float


HORIZONS = {"1y": Horizon("1y", 252, 1.10), "5y": Horizon("5y", 1260, 1.50)}

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("asset_name", T.StringType()),
        T.StructField("event_time", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("signal", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("signal_1y", T.StringType()),
        T.StructField("confidence_1y", T.DoubleType()),
        T.StructField("signal_5y", T.StringType()),
        T.StructField("confidence_5y", T.DoubleType()),
        T.StructField("combined_confidence", T.DoubleType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("risk_bucket", T.StringType()),
        T.StructField("suggested_position_pct", T.DoubleType()),
        T.StructField("expected_return_1y", T.DoubleType()),
        T.StructField("risk_adjusted_score", T.DoubleType()),
        T.StructField("var_95_1d", T.DoubleType()),
        T.StructField("cvar_95_1d", T.DoubleType()),
    ]
)

AUDIT_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("audit_id", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("target_table", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("rows_source", T.LongType()),
        T.StructField("rows_target", T.LongType()),
        T.StructField("rows_inserted", T.LongType()),
        T.StructField("rows_updated", T.LongType()),
        T.StructField("rows_deleted", T.LongType()),
        T.StructField("row_count_match", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
    ]
)

REGIME_ROW = T.StructType(
    [
        T.StructField("regime", T.StringType()),
        T.StructField("samples", T.DoubleType()),
        T.StructField("hit_rate", T.DoubleType()),
        T.StructField("avg_return", T.DoubleType()),
        T.StructField("avg_benchmark_return", T.DoubleType()),
    ]
)

SUMMARY_FIELDS = [
    "splits_ran",
    "avg_roc_auc",
    "avg_f1",
    "avg_brier",
    "avg_cagr_approx",
    "avg_sharpe_annualized",
    "avg_max_drawdown",
    "avg_hit_rate",
]

HORIZON_ROW = T.StructType(
    [
        T.StructField("horizon", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("selected_model_type", T.StringType()),
        T.StructField("recommended_min_prob", T.DoubleType()),
        T.StructField(
            "summary", T.StructType([T.StructField(c, T.DoubleType()) for c in SUMMARY_FIELDS])
        ),
        T.StructField("drift_status", T.StringType()),
        T.StructField(
            "drift_summary",
            T.StructType(
                [
                    T.StructField("avg_psi", T.DoubleType()),
                    T.StructField("avg_ks", T.DoubleType()),
                    T.StructField("high_drift_features", T.DoubleType()),
                    T.StructField("medium_drift_features", T.DoubleType()),
                    T.StructField("recent_start", T.StringType()),
                    T.StructField("recent_end", T.StringType()),
                ]
            ),
        ),
        T.StructField("regime_rows", T.ArrayType(REGIME_ROW)),
    ]
)

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("source_table", T.StringType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("horizons", T.ArrayType(HORIZON_ROW)),
    ]
)
