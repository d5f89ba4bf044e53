"""Freshness SLA, promotion gate, report completeness and training-gate scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbar.functions.nulls import safe_float
from lumenbar.operators.panel import latest_per
from lumenbar.schemas import REPORT_ARTIFACTS
from lumenbar.sources.reports import read_artifacts, read_training_metrics, safe_name


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def freshness(
    df: DataFrame,
    as_of: str,
    max_age_hours: float = 72.0,
    min_rows: int = 100,
    time: str = "event_time",
) -> DataFrame:
    """One status row: row count, newest timestamp, age in hours, reason when it fails."""
    stats = df.agg(F.count("*").alias("row_count"), F.max(time).alias("max_event_time"))
    age = (_seconds(F.lit(as_of)) - _seconds(F.col("max_event_time"))) / 3600.0
    reason = (
        F.when(F.col("row_count") < min_rows, "too_few_rows")
        .when(F.col("max_event_time").isNull(), "no_timestamp")
        .when(F.col("age_hours") > max_age_hours, "stale")
    )
    return (
        stats.withColumn("age_hours", age)
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))
    )


def assert_fresh(df: DataFrame, table: str, as_of: str, **limits) -> dict:
    row = freshness(df, as_of, **limits).first().asDict()
    if row["status"] != "ok":
        raise ValueError(
            f"Freshness SLA failed for {table}: {row['reason']} (rows={row['row_count']}, "
            f"newest={row['max_event_time']}, age_hours={row['age_hours']})"
        )
    return row


def parse_horizons(required: str | Sequence[str] | None) -> list[str]:
    """Comma list or sequence to lower-case names; empty means the one-year horizon."""
    items = required.split(",") if isinstance(required, str) else list(required or [])
    cleaned = [str(x).strip().lower() for x in items]
    return [x for x in cleaned if x] or ["1y"]


def promotion_gate(
    reports: DataFrame,
    tables: DataFrame,
    as_of: str,
    required_horizons: str | Sequence[str] | None = None,
    min_avg_roc_auc: float = 0.54,
    min_avg_f1: float = 0.40,
    max_high_drift_features: float = 10,
    max_report_age_days: float = 10.0,
    require_drift_ok: bool = True,
) -> DataFrame:
    """One row per (table, required horizon) with the first failed rule as ``reason``.

    ``reports``: one row per table and horizon (see ``sources.reports``); ``tables`` holds
    the ``source_table`` names to promote.
    """
    wanted = parse_horizons(required_horizons)
    needed = tables.select("source_table").withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in wanted]))
    )
    report_time = reports.groupBy("source_table").agg(F.max("generated_at").alias("generated_at"))
    rows = reports.select(
        "source_table",
        F.lower("horizon").alias("horizon"),
        F.lower(F.coalesce("status", F.lit("unknown"))).alias("horizon_status"),
        safe_float(F.col("avg_roc_auc")).alias("avg_roc_auc"),
        safe_float(F.col("avg_f1")).alias("avg_f1"),
        F.lower(F.coalesce("drift_status", F.lit("unknown"))).alias("drift_status"),
        safe_float(F.col("drift_high_features")).alias("high_drift_features"),
    )
    age = (_seconds(F.lit(as_of)) - _seconds(F.col("generated_at"))) / 86400.0
    auc, f1 = F.col("avg_roc_auc"), F.col("avg_f1")
    drift_bad = (F.col("drift_status") != "ok") if require_drift_ok else F.lit(False)
    reason = (
        F.when(F.col("generated_at").isNull(), "missing_report")
        .when(F.col("report_age_days") > max_report_age_days, "stale_report")
        .when(F.col("horizon_status").isNull(), "missing_horizon")
        .when(F.col("horizon_status") != "ok", "status_not_ok")
        .when(auc.isNull() | (auc < min_avg_roc_auc), "low_roc_auc")
        .when(f1.isNull() | (f1 < min_avg_f1), "low_f1")
        .when(drift_bad, "drift_not_ok")
        .when(F.col("high_drift_features") > max_high_drift_features, "high_drift")
    )
    return (
        needed.join(report_time, "source_table", "left")
        .join(rows, ["source_table", "horizon"], "left")
        .withColumn("report_age_days", age)
        .withColumn("reason", reason)
        .withColumn("gate_status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))
    )


def assert_promotable(gate: DataFrame) -> None:
    bad = (
        gate.where(F.col("gate_status") != "ok")
        .orderBy("source_table", "horizon")
        .select("source_table", "horizon", "reason")
        .first()
    )
    if bad:
        raise ValueError(f"Promotion gate failed for {bad[0]} [{bad[1]}]: {bad[2]}")


def report_completeness(
    tables: DataFrame,
    artifacts: DataFrame,
    cutoff: str,
    required: Sequence[str] = REPORT_ARTIFACTS,
) -> DataFrame:
    """One row per (source_table, artifact): ok, missing, stale or invalid.

    ``artifacts``: source_table, artifact, generated_at, has_horizons. A summary artifact
    without a horizon list is invalid; an invalid one may be stale as well.
    """
    expected = tables.select("source_table").withColumn(
        "artifact", F.explode(F.array(*[F.lit(a) for a in required]))
    )
    newest = artifacts.groupBy("source_table", "artifact").agg(
        F.max("generated_at").alias("generated_at"),
        F.max_by("has_horizons", "generated_at").alias("has_horizons"),
    )
    found = F.col("generated_at").isNotNull()
    return (
        expected.join(newest, ["source_table", "artifact"], "left")
        .withColumns(
            {
                "is_missing": ~found,
                "is_stale": found
                & (F.col("generated_at").cast("timestamp") < F.lit(cutoff).cast("timestamp")),
                "is_invalid": found
                & F.col("artifact").endswith("walk_forward_summary.json")
                & ~F.coalesce("has_horizons", F.lit(False)),
            }
        )
        .withColumn("is_stale", F.coalesce("is_stale", F.lit(False)))
        .drop("has_horizons")
    )


def folder_completeness(
    spark: SparkSession,
    folder: str,
    source_tables: Sequence[str],
    cutoff: str,
    required: Sequence[str] = REPORT_ARTIFACTS,
) -> DataFrame:
    """``report_completeness`` of the files in a report folder, under the tables' own names."""
    names = spark.createDataFrame(
        [(t, safe_name(t)) for t in source_tables], "_table string, source_table string"
    )
    checked = report_completeness(names, read_artifacts(spark, folder), cutoff, required)
    named = names.join(checked, "source_table").drop("source_table")
    return named.withColumnRenamed("_table", "source_table").select("source_table", *checked.columns[1:])


def folder_gate_failures(spark: SparkSession, folder: str) -> DataFrame:
    """``gate_failures`` of the metrics files in a model folder; unreadable ones are left out."""
    metrics = read_training_metrics(spark, folder)
    return gate_failures(metrics.where(~F.col("parse_failed")))


def completeness_summary(checked: DataFrame) -> DataFrame:
    """One row: counts and up to three samples of missing, stale and invalid artifacts."""
    flags = ["missing", "stale", "invalid"]
    out = checked.agg(*[F.count_if(f"is_{f}").alias(f) for f in flags])
    for f in flags:
        # a top three, then one row
        names = (
            checked.where(f"is_{f}")
            .select(F.concat_ws("/", "source_table", "artifact").alias("_n"))
            .orderBy("_n")
            .limit(3)
        )
        sample = names.agg(F.array_sort(F.collect_list("_n")).alias(f"{f}_sample"))
        out = out.crossJoin(F.broadcast(sample))
    bad = (F.col("missing") > 0) | (F.col("stale") > 0) | (F.col("invalid") > 0)
    return out.withColumn("status", F.when(bad, "failed").otherwise("ok"))


def assert_complete(checked: DataFrame) -> None:
    row = completeness_summary(checked).first()
    if row["status"] != "ok":
        parts = [
            f"{k}={row[k]} {row[k + '_sample']}" for k in ("missing", "stale", "invalid") if row[k]
        ]
        raise ValueError("Walk-forward report validation failed. " + " | ".join(parts))


def gate_failures(metrics: DataFrame) -> DataFrame:
    """Latest training metrics per table and horizon that fell back on a schema or
    freshness gate. ``metrics``: source_table, horizon, status, reason, updated_at."""
    keyed = metrics.withColumn("horizon", F.coalesce("horizon", F.lit("unknown")))
    last = latest_per(keyed, ["source_table", "horizon"], ["updated_at", "reason"])
    pattern = r"^(schema|freshness)_gate_failed_(.*)$"
    kind = F.regexp_extract(F.coalesce("reason", F.lit("")), pattern, 1)
    detail = F.regexp_extract(F.coalesce("reason", F.lit("")), pattern, 2)
    return (
        last.where((F.lower("status") == "fallback") & (kind != ""))
        .select(
            kind.alias("gate_type"),
            detail.alias("gate_detail"),
            "reason",
            "source_table",
            "horizon",
            "updated_at",
        )
        .orderBy("source_table", "horizon", "gate_type")
    )
