"""Training: gates, candidates, calibration, selection, ensemble, persistence (pyspark.ml)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbar.functions.nulls import clip
from lumenbar.operators.labels import (
    first_rows_filter,
    most_recent,
    training_profile,
    training_rows,
)
from lumenbar.operators.metrics import candidate_order, class_report, classification_metrics
from lumenbar.operators.panel import latest_per
from lumenbar.operators.quantiles import outlier_rate, winsorize
from lumenbar.schemas import FEATURES, HORIZONS, MODEL_NAMES, NAV_FEATURES
from lumenbar.session import stored

FALLBACK = "dummy_constant_0"


@dataclass(frozen=True)
class ModelSettings:
    """Model sizes. ``boost_rounds`` and ``trees`` are what makes training long."""

    boost_rounds: int = 250
    boost_rate: float = 0.05
    boost_depth: int = 8
    boost_min_rows: int = 40
    # Above so many rows a share of them is held to end boosting early; None never does.
    boost_stop_rows: int | None = 10_000
    boost_held_share: float = 0.1
    boost_tolerance: float = 1e-7
    trees: int = 120
    trees_5y: int = 200
    tree_depth: int = 12
    linear_iterations: int = 700
    seed: int = 42


@dataclass(frozen=True)
class TrainingSettings:
    candidates: tuple[str, ...] = tuple(MODEL_NAMES)
    models: ModelSettings = field(default_factory=ModelSettings)
    min_rows: int = 5000
    min_symbols: int = 25
    min_positive_rate: float = 0.01
    max_positive_rate: float = 0.99
    max_outlier_rate: float = 0.20
    max_source_age_days: float = 10
    calibration_fraction: float = 0.15
    # Below any of these the model stays uncalibrated, and its metadata say so.
    calibration_min_total: int = 3000
    calibration_min_held: int = 800
    calibration_min_fit: int = 1500
    ensemble: bool = True
    # Row limits of a single machine; None keeps every row.
    max_rows: int | None = None
    candidate_rows: int | None = None


@dataclass
class Component:
    name: str
    model: PipelineModel
    calibrator: LogisticRegressionModel | None = None
    weight: float = 1.0
    calibration_rows: int = 0
    calibration: str = "none"
    #: boosting rounds kept; None for other models
    rounds: int | None = None


@dataclass
class Artifact:
    """One model, a weighted vote of several, or (no components) the constant 0."""

    features: list[str]
    components: list[Component]
    metadata: dict = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return "ensemble" if len(self.components) > 1 else "single"

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Adds the probability; the model's own features are read with 0 where missing."""
        if not self.components:
            return df.withColumn(out, F.lit(0.0))
        given = df.columns
        own = [f for f in self.features if f in given]
        df = df.withColumns({f"_given_{f}": F.col(f) for f in own}).fillna(0.0, subset=own)
        for i, component in enumerate(self.components):
            df = component_score(df, component, f"_part{i}")
        vote = weighted_vote(
            [F.col(f"_part{i}") for i in range(len(self.components))],
            [c.weight for c in self.components],
        )
        back = [F.col(f"_given_{c}").alias(c) if c in own else F.col(c) for c in given]
        return df.select(*back, vote.alias(out))


def weighted_vote(probabilities: Sequence[Column], weights: Sequence[float]) -> Column:
    """Mean of the probabilities by weight, within 0 and 1."""
    parts = [p * w for p, w in zip(probabilities, weights)]
    return clip(sum(parts[1:], parts[0]) / sum(weights), 0.0, 1.0)


def component_score(df: DataFrame, component: Component, out: str) -> DataFrame:
    columns = df.columns
    raw = vector_to_array("probability")[1]
    scored = component.model.transform(df).select(*columns, raw.alias("_raw"))
    if component.calibrator is None:
        return scored.withColumn(out, clip(F.col("_raw"), 0.0, 1.0)).select(*columns, out)
    return (
        component.calibrator.transform(_calibration_input(scored))
        .withColumn(out, clip(vector_to_array("_calibrated")[1], 0.0, 1.0))
        .select(*columns, out)
    )


def _calibration_input(df: DataFrame) -> DataFrame:
    bounded = df.withColumn("_px", clip(F.col("_raw"), 1e-6, 1 - 1e-6))
    return VectorAssembler(inputCols=["_px"], outputCol="_pv").transform(bounded)


def with_class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Balanced weights n / (2 n_class) as ``_weight``, from one two-row aggregate."""
    counts = {int(r[0]): int(r[1]) for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (2.0 * n)).otherwise(weight)
    return df.withColumn("_weight", weight)


def model_pipeline(
    name: str,
    features: Sequence[str],
    rows: int,
    horizon: str = "1y",
    settings: ModelSettings = ModelSettings(),
) -> Pipeline:
    common = {"labelCol": "target", "probabilityCol": "probability"}
    assemble = VectorAssembler(inputCols=list(features), outputCol="_x")
    if name == "histgb":
        model = GBTClassifier(
            labelCol="target",
            featuresCol="_x",
            stepSize=settings.boost_rate,
            maxIter=settings.boost_rounds,
            maxDepth=settings.boost_depth,
            minInstancesPerNode=settings.boost_min_rows,
            seed=settings.seed,
        )
        return Pipeline(stages=[assemble, model])
    if name == "rf":
        model = RandomForestClassifier(
            featuresCol="_x",
            weightCol="_weight",
            numTrees=settings.trees_5y if horizon == "5y" else settings.trees,
            maxDepth=settings.tree_depth,
            featureSubsetStrategy="sqrt",
            seed=settings.seed,
            **common,
        )
        return Pipeline(stages=[assemble, model])
    if name == "logreg":
        scale = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True)
        model = LogisticRegression(
            featuresCol="_z",
            weightCol="_weight",
            maxIter=settings.linear_iterations,
            # one unit of L2 penalty over the whole data, as a mean loss
            regParam=1.0 / max(rows, 1),
            standardization=False,
            **common,
        )
        return Pipeline(stages=[assemble, scale, model])
    raise ValueError(f"unknown model {name}")


def held_for_stopping(df: DataFrame, share: float, seed: int) -> Column:
    """True for about ``share`` of the rows, by a hash of what names a row.

    The same rows are held however the frame is dealt over partitions.
    """
    names = [c for c in ("symbol", "event_time", "event_date") if c in df.columns] or df.columns
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names], F.lit(str(seed)))
    return F.substring(F.md5(key), 1, 6) < F.lit(f"{int(share * 0x1000000):06x}")


def rounds_of(model: PipelineModel) -> int | None:
    last = model.stages[-1]
    return last.getNumTrees if isinstance(last, GBTClassificationModel) else None


def fit_model(
    df: DataFrame, name: str, features: Sequence[str], rows: int, horizon: str,
    settings: ModelSettings,
) -> PipelineModel:
    """Boosting stops when a round no longer improves the loss on the held rows.

    That is the first such round; the model keeps the rounds up to the best one.
    """
    pipeline = model_pipeline(name, features, rows, horizon, settings)
    if name != "histgb":
        return pipeline.fit(with_class_weights(df))
    if settings.boost_stop_rows is not None and rows > settings.boost_stop_rows:
        held = held_for_stopping(df, settings.boost_held_share, settings.seed)
        booster = pipeline.getStages()[-1]
        booster.setValidationIndicatorCol("_held")
        booster.setParams(validationTol=settings.boost_tolerance)
        df = df.withColumn("_held", held)
    return pipeline.fit(df)


@dataclass
class CalibrationFrames:
    """Older rows to fit on, the most recent ones to calibrate on (filters of one frame)."""

    fit: DataFrame
    recent: DataFrame | None
    fit_rows: int
    held: int = 0


def calibration_frames(
    df: DataFrame, rows: int, settings: TrainingSettings = TrainingSettings()
) -> CalibrationFrames:
    """Splits a stored frame of ``rows`` rows; too small a frame is kept whole."""
    held = int(rows * settings.calibration_fraction)
    if (
        rows < settings.calibration_min_total
        or held < settings.calibration_min_held
        or rows - held < settings.calibration_min_fit
    ):
        return CalibrationFrames(df, None, rows)
    older = first_rows_filter(df, rows - held)
    return CalibrationFrames(df.where(older), df.where(~older), rows - held, held)


def fit_calibrated(
    frames: CalibrationFrames,
    name: str,
    features: Sequence[str],
    horizon: str,
    settings: TrainingSettings,
) -> Component:
    """Fit on the older rows and Platt-calibrate on the held ones, when there are any."""
    model = fit_model(frames.fit, name, features, frames.fit_rows, horizon, settings.models)
    if frames.recent is None:
        return Component(name, model, calibration="too_few_rows", rounds=rounds_of(model))
    calibrator = None
    if frames.recent.select("target").distinct().count() == 2:
        raw = model.transform(frames.recent).select(
            "target", vector_to_array("probability")[1].alias("_raw")
        )
        calibrator = LogisticRegression(
            featuresCol="_pv",
            labelCol="target",
            weightCol="_weight",
            probabilityCol="_calibrated",
            rawPredictionCol="_calibrated_raw",
            predictionCol="_calibrated_label",
            maxIter=1000,
            regParam=1.0 / frames.held,
            standardization=False,
        ).fit(_calibration_input(with_class_weights(raw)))
    outcome = "one_class" if calibrator is None else "platt"
    return Component(
        name, model, calibrator, calibration_rows=frames.held, calibration=outcome,
        rounds=rounds_of(model),
    )


def active_features(df: DataFrame) -> list[str]:
    """The base features plus the fund features the table has."""
    return FEATURES + [c for c in NAV_FEATURES if c in df.columns]


def _gate_source(df: DataFrame, features: Sequence[str], as_of: datetime, limit: float):
    missing = sorted({"symbol", "event_time", "close", *features} - set(df.columns))
    if missing:
        return f"schema_gate_failed_missing_columns={','.join(missing)}", "", ""
    newest = df.agg(F.unix_micros(F.max("event_time").cast("timestamp"))).first()[0]
    if newest is None:
        return "freshness_gate_failed_no_event_time", "ok", ""
    # the table's times are UTC; so is a time without a zone
    at = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    seconds = at.timestamp() - newest / 1e6
    age = seconds / 86400.0
    if age > limit:
        return (
            f"freshness_gate_failed_stale_data_age_days={age:.2f}_gt_{limit:g}",
            "ok",
            "",
        )
    return None, "ok", f"age_days={age:.2f}"


def _gate_profile(profile, settings: TrainingSettings, bars_ahead: int) -> str | None:
    rows, symbols, rate = profile["row_count"], profile["symbol_count"], profile["positive_rate"]
    if rows == 0:
        return f"no_rows_after_labeling_need_{bars_ahead}_days"
    if rows < settings.min_rows:
        return f"insufficient_rows_{rows}_lt_{settings.min_rows}"
    if symbols < settings.min_symbols:
        return f"insufficient_symbols_{symbols}_lt_{settings.min_symbols}"
    low, high = settings.min_positive_rate, settings.max_positive_rate
    if rate <= low or rate >= high:
        return f"class_imbalance_rate_{rate:.6f}_outside_{low}_{high}"
    return None


def train_horizon(
    table: DataFrame,
    source_table: str,
    horizon: str,
    as_of: datetime,
    settings: TrainingSettings = TrainingSettings(),
) -> Artifact:
    """Gates, winsorized labelled rows, candidate ranking on the newest 20 %, refit on all.

    ``eval_*`` metadata are hold-out metrics of the selected candidates (fitted on the
    older 80 %); ``refit_*`` are those of the deployed model on the same rows, which
    it has seen. A failed gate returns the constant-0 artifact with its reason.
    """
    spec = HORIZONS[horizon]
    features = active_features(table)
    base = {"source_table": source_table, "horizon": horizon, "days_forward": spec.bars_ahead}

    def fallback(reason: str) -> Artifact:
        meta = {**base, "status": "fallback", "reason": reason, "selected_model_type": FALLBACK}
        return Artifact(list(FEATURES), [], meta)

    reason, schema_msg, fresh_msg = _gate_source(
        table, features, as_of, settings.max_source_age_days
    )
    if reason:
        return fallback(reason)
    labelled = training_rows(table, spec, features).select(
        "symbol", "event_time", "close", "target", *features
    )
    if settings.max_rows:
        labelled = most_recent(labelled, settings.max_rows)
    labelled = stored(labelled, "event_time")
    profile = training_profile(labelled).first()
    reason = _gate_profile(profile, settings, spec.bars_ahead)
    if reason:
        return fallback(reason)
    rate = float(outlier_rate(labelled, features).first()[0])
    if rate > settings.max_outlier_rate:
        return fallback(f"outlier_rate_{rate:.4f}_gt_{settings.max_outlier_rate}")
    clean = stored(winsorize(labelled, features), "event_time")
    rate_after = float(outlier_rate(clean, features).first()[0])
    rows = int(profile["row_count"])
    older_rows = int(rows * 0.8)
    is_older = first_rows_filter(clean, older_rows)
    older, newer = clean.where(is_older), clean.where(~is_older)
    if older_rows == rows or older.select("target").distinct().count() < 2:
        return fallback("invalid_train_test_split")

    sample_rows = min(older_rows, settings.candidate_rows or older_rows)
    sample = older
    if sample_rows < older_rows:
        sample = older.where(~first_rows_filter(older, older_rows - sample_rows))
    ranking, fitted, failed = rank_candidates(
        sample, sample_rows, newer, features, horizon, settings
    )
    if not ranking:
        return fallback("all_candidate_models_failed")
    chosen = ranking[: 2 if settings.ensemble else 1]
    weights = {r["model_name"]: max(0.01, float(r["roc_auc"] or 0.01)) for r in chosen}
    frames = calibration_frames(clean, rows, settings)
    components = []
    for name, weight in weights.items():
        fitted[name].weight = weight
        part = fit_calibrated(frames, name, features, horizon, settings)
        part.weight = weight
        components.append(part)
    held_out = Artifact(features, [fitted[n] for n in weights])
    artifact = Artifact(features, components)
    metrics = {}
    for prefix, scorer in (("eval", held_out), ("refit", artifact)):
        row = classification_metrics(scorer.score(newer)).first()
        for m in ("accuracy", "f1", "brier", "roc_auc"):
            metrics[f"{prefix}_{m}"] = row[m]
    artifact.metadata = {
        **base,
        "status": "ok",
        "reason": None,
        "row_count": profile["row_count"],
        "symbol_count": profile["symbol_count"],
        "positive_rate": profile["positive_rate"],
        "schema_check": schema_msg,
        "freshness_check": fresh_msg,
        "outlier_rate_pre_winsor": rate,
        "outlier_rate_post_winsor": rate_after,
        "candidate_leaderboard": [{**r.asDict(), "status": "ok"} for r in ranking] + failed,
        "calibration": {c.name: c.calibration for c in components},
        "boost_rounds": {c.name: c.rounds for c in components if c.rounds is not None},
        "class_report": [
            r.asDict()
            for r in class_report(
                artifact.score(newer).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
            ).collect()
        ],
        "settings": settings_record(settings),
        "selected_model_type": chosen[0]["model_name"],
        "selected_models": list(weights),
        "model_kind": artifact.kind,
        "calibration_fraction": settings.calibration_fraction,
        **metrics,
    }
    return artifact


def rank_candidates(
    train: DataFrame,
    train_rows: int,
    test: DataFrame,
    features: Sequence[str],
    horizon: str,
    settings: TrainingSettings,
):
    """Fit every candidate, score the hold-out rows, rank. One metrics job for all."""
    frames = calibration_frames(train, train_rows, settings)
    fitted, failed = {}, []
    for name in dict.fromkeys(settings.candidates):
        try:
            fitted[name] = fit_calibrated(frames, name, features, horizon, settings)
        except Exception as failure:  # one candidate must not end the others
            failed.append({"model_name": name, "status": "failed", "reason": str(failure)})
    scored = None
    for name, component in fitted.items():
        part = component_score(test, component, "prob").select(
            F.lit(name).alias("model_name"), "target", "prob"
        )
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return [], {}, failed
    table = classification_metrics(scored, ["model_name"]).orderBy(
        *candidate_order(), "model_name"
    )
    # one row per candidate
    return table.collect(), fitted, failed


def train_all_horizons(
    table: DataFrame, source_table: str, as_of: datetime,
    settings: TrainingSettings = TrainingSettings(),
) -> dict[str, Artifact]:
    return {h: train_horizon(table, source_table, h, as_of, settings) for h in HORIZONS}


# --- persistence ------------------------------------------------------------------


def save_artifact(spark: SparkSession, artifact: Artifact, path: str) -> None:
    """Models as pyspark.ml folders, the rest as a one-row JSON table."""
    parts = []
    for i, c in enumerate(artifact.components):
        c.model.write().overwrite().save(f"{path}/model_{i}")
        if c.calibrator is not None:
            c.calibrator.write().overwrite().save(f"{path}/calibrator_{i}")
        parts.append(
            {
                "name": c.name,
                "weight": c.weight,
                "calibrated": c.calibrator is not None,
                "calibration_rows": c.calibration_rows,
                "calibration": c.calibration,
                "rounds": c.rounds,
            }
        )
    body = {
        "features": artifact.features,
        "components": parts,
        "metadata": artifact.metadata,
    }
    row = [(json.dumps(body, default=str),)]
    spark.createDataFrame(row, "artifact string").coalesce(1).write.mode("overwrite").text(
        f"{path}/artifact"
    )


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    body = json.loads(spark.read.text(f"{path}/artifact").first()[0])
    parts = []
    for i, c in enumerate(body["components"]):
        calibrator = (
            LogisticRegressionModel.load(f"{path}/calibrator_{i}") if c["calibrated"] else None
        )
        model = PipelineModel.load(f"{path}/model_{i}")
        parts.append(Component(c["name"], model, calibrator, c["weight"], c["calibration_rows"], c["calibration"], c.get("rounds")))
    return Artifact(body["features"], parts, body["metadata"])


RUN_FIELDS = (
    "run_id string, updated_at timestamp, source_table string, horizon string, status string, "
    "reason string, model_path string, selected_model_type string, model_kind string, "
    "row_count bigint, eval_roc_auc double, eval_brier double, eval_f1 double, metadata string"
)


def run_record(
    spark: SparkSession, artifact: Artifact, model_path: str, at: datetime
) -> DataFrame:
    """One row for the append-only training log."""
    m = artifact.metadata
    row = (
        f"run_{at:%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:8]}",
        at,
        m.get("source_table"),
        m.get("horizon"),
        m.get("status"),
        m.get("reason"),
        model_path,
        m.get("selected_model_type"),
        m.get("model_kind", artifact.kind),
        m.get("row_count"),
        m.get("eval_roc_auc"),
        m.get("eval_brier"),
        m.get("eval_f1"),
        json.dumps(m, default=str),
    )
    return spark.createDataFrame([row], RUN_FIELDS)


def registry(runs: DataFrame) -> DataFrame:
    """Latest run of every table and horizon."""
    return latest_per(runs, ["source_table", "horizon"], ["updated_at", "run_id"])


def settings_record(settings: TrainingSettings) -> dict:
    return asdict(settings)
