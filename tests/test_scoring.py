"""Label boundaries and risk columns."""

import math

import pytest
from pyspark.sql import functions as F

from lumenbar.functions.nulls import safe_float
from lumenbar.functions.scoring import signal_label, with_risk_columns
from lumenbar.schemas import SIGNAL_THRESHOLDS

ROW = dict(close=2500.0, rsi_14=55.0, volatility_7d=0.025, sma_50=2450.0, sma_200=2300.0, atr_14=45.0)


def risk(spark, p1=0.7, p5=0.6, **changes):
    row = {**ROW, **changes, "p1": p1, "p5": p5}
    schema = ", ".join(f"{k} double" for k in row)
    df = spark.createDataFrame([tuple(row.values())], schema)
    return with_risk_columns(df, "p1", "p5").first()


def test_label_boundaries(spark):
    cases = [
        (0.72, "1y", "INVEST NOW"), (0.719, "1y", "ACCUMULATE"), (0.58, "1y", "ACCUMULATE"),
        (0.42, "1y", "MONITOR"), (0.25, "1y", "WAIT"), (0.0, "1y", "AVOID"),
        (0.70, "5y", "STRONG HOLD"), (0.699, "5y", "ACCUMULATE"), (0.19, "5y", "AVOID"),
    ]
    for p, horizon, label in cases:
        got = spark.range(1).select(signal_label(F.lit(p), horizon)).first()[0]
        assert got == label, (p, horizon)


def test_thresholds_descend():
    for table in SIGNAL_THRESHOLDS.values():
        bounds = [t for t, _ in table]
        assert bounds == sorted(bounds, reverse=True)


def test_risk_values(spark):
    r = risk(spark)
    vol, atr = 0.025 / 0.06, 45 / 2500 / 0.08
    raw = 0.40 * vol + 0.30 * atr + 0.15 * 0.1
    assert r.combined_confidence == pytest.approx(0.65 * 0.7 + 0.35 * 0.6)
    assert r.risk_score == pytest.approx(raw * 100)
    assert r.risk_bucket == "LOW"
    conviction = (r.combined_confidence - 0.5) / 0.5
    assert r.suggested_position_pct == pytest.approx(0.01 + 0.11 * conviction * (1 - 0.75 * raw))
    assert r.cvar_95_1d >= r.var_95_1d >= 0


def test_risk_edges(spark):
    assert 0 <= risk(spark, close=0.0).risk_score <= 100
    assert risk(spark, sma_200=0.0).risk_score == pytest.approx(risk(spark, sma_200=2000.0).risk_score)
    # an RSI of exactly 0 counts as the default 50
    assert risk(spark, rsi_14=0.0).risk_score == pytest.approx(risk(spark, rsi_14=50.0).risk_score)
    assert risk(spark, volatility_7d=None).risk_score < risk(spark).risk_score
    worst = risk(spark, p1=0.0, p5=0.0, volatility_7d=9.0, atr_14=900.0, rsi_14=99.0, sma_50=10.0)
    assert worst.risk_bucket == "HIGH" and worst.suggested_position_pct == pytest.approx(0.01)
    assert risk(spark, p1=1.0, p5=1.0, volatility_7d=0.001).suggested_position_pct <= 0.12


def test_safe_float(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(safe_float(F.col("v"), -1.0)).collect()]
    assert got == [1.5, -1.0, -1.0, -1.0]
    assert math.isclose(df.select(safe_float(F.col("v"))).first()[0], 1.5)
