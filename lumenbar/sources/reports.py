"""Validation reports: one JSON summary and six CSV tables per feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lumenbar.functions.formatting import number_text, percent_text
from lumenbar.functions.nulls import safe_float
from lumenbar.schemas import REGIMES, REPORT_SCHEMA, SUMMARY_FIELDS

CSV_PARTS = ["splits", "buckets", "regimes", "thresholds", "model_compare", "drift"]
_CORRUPT = "_corrupt_record"


def safe_name(source_table: str) -> str:
    return source_table.replace(".", "_")


def write_report(
    folder: str, source_table: str, summary: DataFrame, parts: dict[str, DataFrame]
) -> dict[str, str]:
    """Writes the summary (rows of ``REPORT_SCHEMA``) and the CSV tables; returns the paths."""
    stem = f"{folder}/{safe_name(source_table)}_walk_forward"
    paths = {"summary_json": f"{stem}_summary.json"}
    summary.write.mode("overwrite").json(paths["summary_json"])
    for part in CSV_PARTS:
        if part in parts:
            paths[f"{part}_csv"] = f"{stem}_{part}.csv"
            parts[part].write.mode("overwrite").csv(paths[f"{part}_csv"], header=True)
    return paths


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Every summary below ``folder``; unreadable JSON is kept with ``parse_failed``."""
    schema = T.StructType([*REPORT_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("multiLine", True)
    try:
        raw = reader.json(f"{folder}/*_walk_forward_summary.json")
    except AnalysisException:
        return spark.createDataFrame(
            [], T.StructType([*REPORT_SCHEMA.fields, T.StructField("parse_failed", T.BooleanType())])
        )
    stem = F.regexp_extract(
        F.col("_metadata.file_path"), r"([^/]+)_walk_forward_summary\.json", 1
    )
    return raw.select(
        stem.alias("source_table"),
        F.col("_metadata.file_modification_time").alias("generated_at"),
        "horizons",
        F.col(_CORRUPT).isNotNull().alias("parse_failed"),
    )


def report_rows(reports: DataFrame, asset_classes: DataFrame) -> DataFrame:
    """One row per (asset class, horizon); tables without a usable report keep one row
    with status missing_report, report_parse_failed or no_horizons.

    ``asset_classes``: asset_class, source_table. ``regime_rows`` stay nested.
    """
    keyed = reports.withColumnRenamed("source_table", "_stem")
    if "parse_failed" not in keyed.columns:
        keyed = keyed.withColumn("parse_failed", F.lit(False))
    joined = asset_classes.join(
        keyed.withColumn("_found", F.lit(True)),
        F.regexp_replace("source_table", r"\.", "_") == F.regexp_replace("_stem", r"\.", "_"),
        "left",
    )
    rows = joined.select(
        "asset_class",
        "source_table",
        "generated_at",
        "_found",
        "parse_failed",
        F.explode_outer("horizons").alias("_h"),
    )
    status = (
        F.when(F.col("_found").isNull(), "missing_report")
        .when(F.col("parse_failed"), "report_parse_failed")
        .when(F.col("_h").isNull(), "no_horizons")
        .otherwise(F.coalesce("_h.status", F.lit("unknown")))
    )
    drift = {
        "drift_avg_psi": "avg_psi",
        "drift_avg_ks": "avg_ks",
        "drift_high_features": "high_drift_features",
        "drift_medium_features": "medium_drift_features",
        "drift_recent_start": "recent_start",
        "drift_recent_end": "recent_end",
    }
    return rows.select(
        "asset_class",
        "source_table",
        F.coalesce("_h.horizon", F.lit("n/a")).alias("horizon"),
        status.alias("status"),
        F.col("_h.selected_model_type").alias("selected_model_type"),
        F.col("_h.recommended_min_prob").alias("recommended_min_prob"),
        *[F.col(f"_h.summary.{c}").alias(c) for c in SUMMARY_FIELDS],
        F.col("_h.drift_status").alias("drift_status"),
        *[F.col(f"_h.drift_summary.{source}").alias(out) for out, source in drift.items()],
        "generated_at",
        F.col("_h.regime_rows").alias("regime_rows"),
    )


_MEASURES = ["hit_rate", "avg_return", "avg_benchmark_return"]


def regime_rollup(
    rows: DataFrame, keys: Sequence[str], missing_as_zero: bool = False
) -> DataFrame:
    """Sample-weighted means per regime, one column per (regime, measure).

    Default form: a missing measure leaves the denominator, regimes match in any case.
    ``missing_as_zero``: a missing measure counts as 0, and without any weight the
    plain mean is used.
    """
    samples = safe_float(F.col("samples"), 0.0)
    weighted = rows.withColumn("_w", F.greatest(samples, F.lit(0.0)))
    name = F.col("regime") if missing_as_zero else F.lower("regime")
    w = F.col("_w")
    aggs: list[Column] = []
    for regime in REGIMES:
        here = name == regime
        total = F.sum(F.when(here, w))
        counted = total if missing_as_zero else F.rint(total)
        aggs.append(counted.cast("long").alias(f"{regime}_samples"))
        for m in _MEASURES:
            v = safe_float(F.col(m))
            if missing_as_zero:
                mean = F.when(
                    total > 0, F.try_divide(F.sum(F.when(here, F.coalesce(v, F.lit(0.0)) * w)), total)
                ).otherwise(F.avg(F.when(here, v)))
            else:
                used = here & v.isNotNull() & (w > 0)
                mean = F.try_divide(F.sum(F.when(used, v * w)), F.sum(F.when(used, w)))
            aggs.append(mean.alias(f"{regime}_{m}"))
    return weighted.groupBy(*keys).agg(*aggs)


def with_regimes(rows: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Adds the rolled-up regime columns to report rows."""
    keys = ["asset_class", "source_table", "horizon"]
    flat = rows.select(*keys, F.inline("regime_rows"))
    return rows.drop("regime_rows").join(regime_rollup(flat, keys, missing_as_zero), keys, "left")


def validation_summary(
    reports: DataFrame, asset_classes: DataFrame, asset_class: str | None = None
) -> DataFrame:
    """Report rows with regimes for one or all asset classes, sorted."""
    wanted = asset_classes
    if asset_class:
        wanted = wanted.where(F.col("asset_class") == asset_class)
    return with_regimes(report_rows(reports, wanted)).orderBy("asset_class", "horizon")


def validation_lines(rows: DataFrame) -> DataFrame:
    """The snapshot section of the report as text, one line per (asset class, horizon)."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("n/a"))

    def whole(c: str) -> Column:
        return F.coalesce(F.col(c).cast("long").cast("string"), F.lit("n/a"))

    head = F.concat(F.lit("- "), F.col("asset_class"), F.lit(" ["), F.col("horizon"), F.lit("]: "))
    detail = F.concat(
        F.lit("model="),
        text("selected_model_type"),
        F.lit(", threshold="),
        percent_text(F.col("recommended_min_prob"), 0),
        F.lit(", ROC-AUC="),
        number_text(F.col("avg_roc_auc")),
        F.lit(", F1="),
        number_text(F.col("avg_f1")),
        F.lit(", splits="),
        whole("splits_ran"),
        F.lit(", drift="),
        text("drift_status"),
        F.lit(" (high="),
        whole("drift_high_features"),
        F.lit(", medium="),
        whole("drift_medium_features"),
        F.lit("), hit-rate bull/bear/sideways="),
        F.concat_ws("/", *[percent_text(F.col(f"{r}_hit_rate")) for r in REGIMES]),
    )
    short = F.concat(F.lit("status="), F.coalesce("status", F.lit("unknown")))
    return rows.select(
        "asset_class",
        "horizon",
        F.concat(head, F.when(F.col("status") == "ok", detail).otherwise(short)).alias("line"),
    ).orderBy("asset_class", "horizon")


# --- report and metrics files as tables ---------------------------------------------

ARTIFACT = r"/([^/]+)_(walk_forward_[a-z_]+\.(?:json|csv))(?:/|$)"
ARTIFACT_FIELDS = "source_table string, artifact string, generated_at timestamp, has_horizons boolean"
METRICS_FIELDS = (
    "source_table string, horizon string, status string, reason string, updated_at timestamp, "
    "path string, parse_failed boolean"
)


def _files(spark: SparkSession, folder: str) -> DataFrame | None:
    """(path, changed, length) of everything below ``folder``; None where it does not exist."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException:
        return None
    # contents are not read for these three
    return found.select("path", F.col("modificationTime").alias("changed"), "length")


def _texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """(path, changed, body) of the files whose path matches; body is NULL if it is no JSON."""
    try:
        found = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    except AnalysisException:
        return None
    path = F.col("_metadata.file_path")
    return found.where(path.rlike(pattern)).select(
        path.alias("path"),
        F.col("_metadata.file_modification_time").alias("changed"),
        F.try_parse_json("value").alias("body"),
    )


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """The report files below ``folder``: source_table (safe name), artifact, generated_at,
    has_horizons.

    An artifact is one file, or a folder of part files as Spark writes them (the newest counts).
    Only summaries are opened: ``has_horizons`` says whether one is JSON with a list of
    horizons. Other files, and a folder that does not exist, give no rows.
    """
    files = _files(spark, folder)
    if files is None:
        return spark.createDataFrame([], ARTIFACT_FIELDS)
    stem, name = F.regexp_extract("path", ARTIFACT, 1), F.regexp_extract("path", ARTIFACT, 2)
    data = ~F.col("path").rlike(r"/[._][^/]*$")
    keys = ["source_table", "artifact"]
    listed = files.where((name != "") & data).groupBy(stem.alias(keys[0]), name.alias(keys[1]))
    listed = listed.agg(F.max("changed").alias("generated_at"))
    bodies = _texts(spark, folder, r"_walk_forward_summary\.json(/[^._][^/]*)?$")
    horizons = F.try_variant_get("body", "$.horizons", "array<variant>").isNotNull()
    good = bodies.groupBy(stem.alias(keys[0]), name.alias(keys[1])).agg(
        F.bool_or(horizons).alias("has_horizons")
    )
    return listed.join(good, keys, "left").select(*keys, "generated_at", "has_horizons")


def read_training_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*_metrics.json`` below ``folder``, unreadable ones with ``parse_failed``.

    Names fall back on the file's name, horizons on "unknown"; the file's time is the run's.
    """
    bodies = _texts(spark, folder, r"_metrics\.json$")
    if bodies is None:
        return spark.createDataFrame([], METRICS_FIELDS)
    # anything but an object holds no fields
    failed = F.col("body").isNull() | ~F.schema_of_variant("body").startswith("OBJECT")

    def text(name: str) -> Column:
        return F.try_variant_get("body", f"$.{name}", "string")

    return bodies.select(
        F.coalesce(text("source_table"), F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("source_table"),
        F.coalesce(text("horizon"), F.lit("unknown")).alias("horizon"),
        text("status").alias("status"),
        text("reason").alias("reason"),
        F.col("changed").alias("updated_at"),
        "path",
        failed.alias("parse_failed"),
    )


def metrics_scan(metrics: DataFrame) -> DataFrame:
    """One row: files scanned, unreadable ones, and (table, horizon) pairs with a metrics file."""
    pair = F.when(~F.col("parse_failed"), F.struct("source_table", "horizon"))
    return metrics.agg(
        F.count("*").alias("scanned_files"),
        F.count_if("parse_failed").alias("unreadable_files"),
        F.count_distinct(pair).alias("tracked_models"),
    )
