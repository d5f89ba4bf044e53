"""Gates, candidates, ensembles, persistence and walk-forward on a small learnable panel."""

from dataclasses import replace
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenbar.plans import scoring, training, walkforward
from lumenbar.schemas import FEATURES
from lumenbar.sources import reports

AS_OF = datetime(2022, 10, 1)
SMALL = training.ModelSettings(
    boost_rounds=2, boost_depth=2, trees=3, trees_5y=3, tree_depth=3, linear_iterations=10
)
SETTINGS = training.TrainingSettings(
    candidates=("rf", "logreg"), models=SMALL, min_rows=1000, min_symbols=5
)


@pytest.fixture(scope="module")
def table(spark):
    """Twelve symbols, 1,000 days; rsi_14 tells how the next year goes."""
    rng = np.random.default_rng(2)
    frames = []
    for s in range(12):
        days = pd.date_range("2020-01-01", periods=1000)
        phase = np.sin(np.arange(1000) / 200 * np.pi + s)
        close = 100 * (1.3 + phase) + rng.normal(0, 1, 1000)
        frame = pd.DataFrame({"symbol": f"S{s:02d}", "event_time": days, "close": close})
        for f in FEATURES:
            frame[f] = rng.normal(50, 10, 1000)
        frame["rsi_14"] = 50 - 40 * phase + rng.normal(0, 5, 1000)
        frame["sma_50"], frame["sma_200"] = close, close
        frames.append(frame)
    df = spark.createDataFrame(pd.concat(frames)).withColumn("event_time", F.to_date("event_time"))
    return df.cache()


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"min_rows": 10**6}, "insufficient_rows_8976_lt_1000000"),
        ({"min_symbols": 99}, "insufficient_symbols_12_lt_99"),
        ({"max_positive_rate": 0.02}, "class_imbalance_rate_"),
        ({"max_outlier_rate": 0.0001}, "outlier_rate_0.00"),
        ({"max_source_age_days": 1}, "freshness_gate_failed_stale_data_age_days="),
    ],
)
def test_gates(table, change, reason):
    out = training.train_horizon(table, "t", "1y", AS_OF, replace(SETTINGS, **change))
    assert out.metadata["status"] == "fallback" and out.metadata["reason"].startswith(reason)
    assert out.score(table).agg(F.max("prob")).first()[0] == 0.0


def test_schema_gate_and_short_history(table):
    out = training.train_horizon(table.drop("macd"), "t", "1y", AS_OF, SETTINGS)
    assert out.metadata["reason"] == "schema_gate_failed_missing_columns=macd"
    out = training.train_horizon(table, "t", "5y", AS_OF, SETTINGS)
    assert out.metadata["reason"] == "no_rows_after_labeling_need_1260_days"


def test_training_scoring_and_reload(spark, table, tmp_path):
    model = training.train_horizon(table, "t", "1y", AS_OF, SETTINGS)
    meta = model.metadata
    assert meta["status"] == "ok" and model.kind == "ensemble" and meta["row_count"] == 8976
    assert meta["eval_roc_auc"] > 0.7
    assert [c.calibration_rows for c in model.components] == [1346, 1346]
    scored = model.score(table).select("prob")
    low, high = scored.agg(F.min("prob"), F.max("prob")).first()
    assert 0 <= low <= high <= 1

    training.save_artifact(spark, model, str(tmp_path / "m"))
    again = training.load_artifact(spark, str(tmp_path / "m"))
    assert again.metadata["selected_models"] == meta["selected_models"]
    keys = ["symbol", "event_time"]
    worst = (
        model.score(table).select(*keys, "prob")
        .join(again.score(table, "p2").select(*keys, "p2"), keys)
        .agg(F.max(F.abs(F.col("prob") - F.col("p2")))).first()[0]
    )
    assert worst < 1e-9

    signals = scoring.generate_signals(
        table, lambda d, o: model.score(d, o), lambda d, o: again.score(d, o)
    )
    assert signals.count() == 12 and signals.where("cvar_95_1d < var_95_1d").count() == 0
    merged = scoring.generate_signals(
        table, lambda d, o: model.score(d, o), lambda d, o: model.score(d, o), existing=signals
    )
    assert merged.count() == 12

    old = training.run_record(spark, model, "p1", datetime(2024, 1, 1))
    new = training.run_record(spark, model, "p2", datetime(2024, 1, 2))
    assert training.registry(old.unionByName(new)).first().model_path == "p2"


def test_row_limit_keeps_newest(table):
    out = training.train_horizon(table, "t", "1y", AS_OF, replace(SETTINGS, max_rows=500))
    assert out.metadata["reason"] == "insufficient_rows_500_lt_1000"


def test_all_model_kinds(table):
    rows = training.training_rows(table, training.HORIZONS["1y"])
    for name in ("histgb", "rf", "logreg"):
        model = training.fit_model(rows, name, FEATURES, 8976, "1y", SMALL)
        part = training.component_score(rows, training.Component(name, model), "p")
        assert part.where("p < 0 OR p > 1 OR p IS NULL").count() == 0
    with pytest.raises(ValueError):
        training.model_pipeline("svm", FEATURES, 1)


def test_walk_forward_report(spark, table, tmp_path):
    settings = walkforward.ValidationSettings(
        candidates=("logreg", "rf"), models=SMALL, min_train_days=400, test_days=100,
        step_days=200, min_prob=0.5, drift_min_samples=50,
    )
    results = walkforward.run_walk_forward(
        table, "silver.t", AS_OF, settings, output=str(tmp_path)
    )
    one, five = results["1y"], results["5y"]
    assert one.status == "ok" and five.status == "no_data"
    assert one.splits.count() == 2 and one.model_compare.count() == 2
    assert one.recommended_min_prob in (0.5, 0.55, 0.6, 0.65, 0.7)
    assert one.buckets.agg(F.sum("samples")).first()[0] <= one.predictions.count() / 2
    assert one.drift.count() == len(FEATURES)
    names = spark.createDataFrame([("x", "silver.t")], "asset_class string, source_table string")
    read = reports.validation_summary(reports.read_reports(spark, str(tmp_path)), names).collect()
    assert [(r.horizon, r.status) for r in read] == [("1y", "ok"), ("5y", "no_data")]
    assert read[0].splits_ran == 2 and read[0].selected_model_type == one.selected_model_type
    csv = spark.read.csv(str(tmp_path / "silver_t_walk_forward_splits.csv"), header=True)
    assert csv.count() == 2


def test_short_history_status(table):
    out = walkforward.evaluate_horizon(
        table, "1y", walkforward.ValidationSettings(min_train_days=5000)
    )
    assert out.status == "insufficient_history"


def test_clean_thresholds():
    assert walkforward.clean_thresholds([0.7, 0.5, 0.5, 1.5]) == [0.5, 0.7]
    with pytest.raises(ValueError):
        walkforward.clean_thresholds([2.0])
