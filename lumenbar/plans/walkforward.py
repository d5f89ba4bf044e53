"""Walk-forward validation: fit per split, then measure every model and split at once."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbar.operators.backtest import (
    backtest,
    confidence_buckets,
    horizon_summary,
    recommended_threshold,
    regime_performance,
    sweep_means,
    threshold_sweep_splits,
)
from lumenbar.operators.drift import drift_summary, drift_windows, feature_drift, value_counts
from lumenbar.operators.labels import validation_rows
from lumenbar.operators.metrics import candidate_order, classification_metrics
from lumenbar.operators.splits import leakage_checks, walk_forward_splits
from lumenbar.plans.training import Component, ModelSettings, component_score, fit_model
from lumenbar.schemas import FEATURES, HORIZONS, MODEL_NAMES, REPORT_SCHEMA, SWEEP_THRESHOLDS
from lumenbar.session import new_folder, stored
from lumenbar.sources.reports import write_report


@dataclass(frozen=True)
class ValidationSettings:
    candidates: tuple[str, ...] = tuple(MODEL_NAMES)
    models: ModelSettings = field(default_factory=lambda: ModelSettings(trees=200))
    features: tuple[str, ...] = tuple(FEATURES)
    min_train_days: int = 504
    test_days: int = 126
    step_days: int = 63
    top_n: int = 10
    min_prob: float = 0.55
    # trading + slippage + brokerage + tax, in basis points
    cost_bps: float = 10.0 + 5.0 + 2.0 + 3.0
    thresholds: tuple[float, ...] = tuple(SWEEP_THRESHOLDS)
    drift_recent_days: int = 63
    drift_baseline_days: int = 252
    drift_min_samples: int = 300
    embargo_days: int = 0
    # fits that the driver submits at a time
    fits_at_once: int = 4

#: Mistakes in code and a full driver are no failure of a fit or a horizon.
FATAL = (TypeError, NameError, AttributeError, MemoryError, ImportError)


SPLIT_FACTS = (
    "split", "train_end", "test_start", "test_end", "train_rows", "test_rows",
    "train_positives", "overlap_rows", "date_violation",
)


def clean_thresholds(values: Sequence[float] | None) -> list[float]:
    """Distinct thresholds inside (0, 1), rounded to four digits, ascending."""
    kept = sorted({round(float(v), 4) for v in values or SWEEP_THRESHOLDS if 0 < float(v) < 1})
    if not kept:
        raise ValueError("no threshold between 0 and 1")
    return kept


@dataclass
class HorizonResult:
    """Frames are None when the status is not ok (drift is always measured)."""

    horizon: str
    status: str
    rows: int = 0
    selected_model_type: str | None = None
    recommended_min_prob: float | None = None
    predictions: DataFrame | None = None
    splits: DataFrame | None = None
    buckets: DataFrame | None = None
    regimes: DataFrame | None = None
    thresholds: DataFrame | None = None
    model_compare: DataFrame | None = None
    threshold_splits: DataFrame | None = None
    failures: tuple[dict, ...] = ()
    drift: DataFrame | None = None
    drift_summary: DataFrame | None = None


def usable_splits(labelled: DataFrame, settings: ValidationSettings) -> list:
    """Splits with both sides filled, no leakage and two classes in train (driver rows)."""
    splits = walk_forward_splits(
        labelled, settings.min_train_days, settings.test_days, settings.step_days
    )
    checks = leakage_checks(
        labelled, splits, target="target", embargo_days=settings.embargo_days
    )
    # one row per split
    return checks.orderBy("split").collect()


def predict_splits(
    labelled: DataFrame,
    checks: Sequence,
    horizon: str,
    settings: ValidationSettings,
    failures: list[dict] | None = None,
) -> DataFrame | None:
    """Test-window probabilities of every model and split.

    A fit that fails is noted in ``failures`` and leaves the others alone.

    The driver submits fits only (each fit is distributed), ``fits_at_once`` at a time, in a
    scheduler pool each: while one fit waits for its last task, others use the cluster. Fits
    are independent and seeded, so the order in which they end changes nothing. Each writes
    its predictions to a folder of its own, so metrics do not replay the models.
    """
    spark = labelled.sparkSession
    path = new_folder(spark)
    tasks = []
    for check in checks:
        one_class = check["train_positives"] in (0, check["train_rows"])
        bad = check["date_violation"] or check["overlap_rows"] > 0 or check["test_rows"] == 0
        if bad or one_class or check["train_rows"] == 0:
            continue
        day = F.col("event_date")
        last = F.least(
            F.lit(check["train_end"]), F.date_sub(F.lit(check["test_start"]), settings.embargo_days + 1)
        )
        train = labelled.where(day <= last)
        test = labelled.where(
            (day >= F.lit(check["test_start"])) & (day <= F.lit(check["test_end"]))
        )
        tasks += [(train, test, check, name) for name in settings.candidates]

    def fit(number: int):
        train, test, check, name = tasks[number]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % settings.fits_at_once}")
        try:
            model = fit_model(
                train, name, settings.features, check["train_rows"], horizon, settings.models
            )
        except FATAL:
            raise
        except Exception as failure:
            if failures is None:
                raise
            reason = f"{type(failure).__name__}: {failure}"
            return None, {"model_type": name, "split": int(check["split"]), "reason": reason}
        scored = component_score(test, Component(name, model), "prob").select(
            F.lit(name).alias("model_type"),
            F.lit(int(check["split"])).alias("split"),
            "symbol",
            "event_date",
            "target",
            "realized_return",
            "prob",
        )
        scored.write.parquet(f"{path}/fit-{number}")
        return scored.schema, None

    with ThreadPoolExecutor(max(1, settings.fits_at_once)) as pool:
        # one wrapped call a task: a wrapper holds the properties of one thread
        ended = [pool.submit(inheritable_thread_target(spark)(fit), i) for i in range(len(tasks))]
        try:
            results = [e.result() for e in ended]
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
    if failures is not None:
        failures += [failed for _, failed in results if failed]
    done = [(i, schema) for i, (schema, _) in enumerate(results) if schema is not None]
    if not done:
        return None
    return spark.read.schema(done[0][1]).parquet(*[f"{path}/fit-{i}" for i, _ in done])


def evaluate_predictions(
    predictions: DataFrame, bars_ahead: int, settings: ValidationSettings
) -> dict[str, DataFrame]:
    """Split metrics, buckets, regimes and threshold sweep of all models in one plan each."""
    by_split = ["model_type", "split"]
    stats = backtest(
        predictions, bars_ahead, by_split, settings.top_n, settings.min_prob, settings.cost_bps
    ).drop("threshold")
    return {
        "splits": classification_metrics(predictions, by_split).join(stats, by_split),
        "buckets": confidence_buckets(predictions, by_split),
        "regimes": regime_performance(predictions, by_split, settings.top_n, settings.min_prob),
        "threshold_splits": (by_threshold := threshold_sweep_splits(
            predictions,
            bars_ahead,
            ["model_type"],
            clean_thresholds(settings.thresholds),
            settings.top_n,
            settings.cost_bps,
        )),
        "thresholds": sweep_means(by_threshold, ["model_type"]),
    }


def evaluate_horizon(
    table: DataFrame, horizon: str, settings: ValidationSettings = ValidationSettings()
) -> HorizonResult:
    spec = HORIZONS[horizon]
    labelled = stored(
        validation_rows(table, spec, settings.features).select(
            "symbol", "event_date", "target", "realized_return", *settings.features
        ),
        "event_date",
    )
    result = _evaluate_labelled(labelled, horizon, spec.bars_ahead, settings)
    windows = drift_windows(labelled, settings.drift_recent_days, settings.drift_baseline_days)
    # five reads of the counts follow
    counts = stored(value_counts(windows, settings.features))
    # a row per feature, and one row
    result.drift = stored(feature_drift(counts, settings.drift_min_samples))
    result.drift_summary = stored(
        drift_summary(windows, result.drift, settings.drift_min_samples)
    )
    return result


def _evaluate_labelled(
    labelled: DataFrame, horizon: str, bars_ahead: int, settings: ValidationSettings
) -> HorizonResult:
    rows = labelled.count()
    if rows == 0:
        return HorizonResult(horizon, "no_data")
    checks = usable_splits(labelled, settings)
    if not checks:
        return HorizonResult(horizon, "insufficient_history", rows)
    failures: list[dict] = []
    predictions = predict_splits(labelled, checks, horizon, settings, failures)
    if predictions is None:
        status = "all_candidate_models_failed" if failures else "no_valid_splits"
        return HorizonResult(horizon, status, rows, failures=tuple(failures))
    # one row per split: its dates, sizes and leakage checks
    facts = labelled.sparkSession.createDataFrame(checks).select(*SPLIT_FACTS)
    frames = evaluate_predictions(predictions, bars_ahead, settings)
    frames["splits"] = frames["splits"].join(F.broadcast(facts), "split")
    broken = sorted({f["model_type"] for f in failures})
    compare = horizon_summary(frames["splits"], ["model_type"]).withColumn(
        "candidate_status",
        F.when(F.col("model_type").isin(broken), "failed").otherwise("ok") if broken else F.lit("ok"),
    )
    order = candidate_order("avg_roc_auc", "avg_brier", "avg_f1", "candidate_status")
    best = compare.orderBy(*order, "model_type").first()["model_type"]
    recommended = (
        recommended_threshold(frames["thresholds"], ["model_type"])
        .where(F.col("model_type") == best)
        .first()
    )
    selected = F.col("model_type") == best
    return HorizonResult(
        horizon,
        "ok",
        rows,
        best,
        recommended["recommended_min_prob"] if recommended else None,
        predictions,
        frames["splits"].where(selected),
        frames["buckets"].where(selected),
        frames["regimes"].where(selected),
        frames["thresholds"].where(selected),
        compare.withColumn("selected_model_type", F.lit(best)),
        frames["threshold_splits"].where(selected),
        tuple(failures),
    )


def run_walk_forward(
    table: DataFrame,
    source_table: str,
    as_of: datetime,
    settings: ValidationSettings = ValidationSettings(),
    output: str | None = None,
    horizons: Sequence[str] = tuple(HORIZONS),
) -> dict[str, HorizonResult]:
    """Every horizon; with ``output`` the report (JSON and CSV tables) is written too."""
    results = {}
    for h in horizons:
        try:
            results[h] = evaluate_horizon(table, h, settings)
        except FATAL:
            raise
        except Exception as failure:  # one horizon must not end the others
            reason = f"{type(failure).__name__}: {failure}"
            results[h] = HorizonResult(h, "load_failed", failures=({"reason": reason},))
    if output:
        write_report(
            output,
            source_table,
            summary_frame(table.sparkSession, source_table, as_of, results),
            _csv_parts(results),
        )
    return results


def summary_frame(spark, source_table: str, as_of: datetime, results) -> DataFrame:
    """The JSON summary as one row: a few numbers per horizon."""
    horizons = []
    for h, r in results.items():
        item = {"horizon": h, "status": r.status, "selected_model_type": r.selected_model_type}
        item["recommended_min_prob"] = r.recommended_min_prob
        if r.model_compare is not None:
            chosen = r.model_compare.where(F.col("model_type") == r.selected_model_type)
            item["summary"] = _floats(chosen.first().asDict(), "summary")
            # regimes x splits rows
            item["regime_rows"] = [
                {**row.asDict(), "samples": float(row["samples"])}
                for row in r.regimes.drop("model_type", "split").collect()
            ]
        if r.drift_summary is not None:
            drift = r.drift_summary.first().asDict()
            item["drift_status"] = drift["status"]
            item["drift_summary"] = _floats(drift, "drift_summary")
        horizons.append(item)
    return spark.createDataFrame([(source_table, as_of, horizons)], REPORT_SCHEMA)


def _floats(values: dict, field_name: str) -> dict:
    element = REPORT_SCHEMA["horizons"].dataType.elementType[field_name].dataType
    out = {}
    for f in element.fields:
        v = values.get(f.name)
        is_number = f.dataType.typeName() == "double" and v is not None
        out[f.name] = float(v) if is_number else v
    return out


def _csv_parts(results) -> dict[str, DataFrame]:
    parts: dict[str, DataFrame] = {}
    for h, r in results.items():
        for name in ("splits", "buckets", "regimes", "thresholds", "threshold_splits", "model_compare", "drift"):
            frame = getattr(r, name)
            if frame is None:
                continue
            tagged = frame.withColumn("horizon", F.lit(h))
            parts[name] = parts[name].unionByName(tagged, True) if name in parts else tagged
    return parts
