"""Audit log, reconciliation, lineage and daily reports as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbar.operators.panel import latest_per
from lumenbar.operators.quality import quality_profile
from lumenbar.schemas import AUDIT_EVENT_SCHEMA
from lumenbar.sources.tables import table_exists


def audit_event(spark: SparkSession, **fields) -> DataFrame:
    """One audit row; absent fields are NULL."""
    row = {f.name: fields.get(f.name) for f in AUDIT_EVENT_SCHEMA}
    return spark.createDataFrame([row], AUDIT_EVENT_SCHEMA)


def start_event(
    spark: SparkSession, job: str, source: str, target: str, operation: str, at: datetime
) -> tuple[str, DataFrame]:
    audit_id = uuid.uuid4().hex
    row = audit_event(
        spark,
        audit_id=audit_id,
        job=job,
        source_table=source,
        target_table=target,
        operation=operation,
        status="RUNNING",
        event_time=at,
        start_time=at,
    )
    return audit_id, row


def end_event(
    spark: SparkSession,
    audit_id: str,
    job: str,
    source: str,
    target: str,
    operation: str,
    started: datetime,
    ended: datetime,
    rows_source: int | None = None,
    rows_target: int | None = None,
    error: str | None = None,
    **counts,
) -> DataFrame:
    match = None
    if rows_source is not None and rows_target is not None:
        match = rows_source == rows_target
    return audit_event(
        spark,
        audit_id=audit_id,
        job=job,
        source_table=source,
        target_table=target,
        operation=operation,
        status="FAILED" if error else "SUCCESS",
        event_time=ended,
        start_time=started,
        end_time=ended,
        duration_seconds=(ended - started).total_seconds(),
        rows_source=rows_source,
        rows_target=rows_target,
        row_count_match=match,
        error_message=error,
        **counts,
    )


def current_state(events: DataFrame) -> DataFrame:
    """Latest event of every audit id (the log itself is append-only)."""
    done = events.withColumn("_done", (F.col("status") != "RUNNING").cast("int"))
    return latest_per(done, ["audit_id"], ["event_time", "_done"]).drop("_done")


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of a parquet table, from the file footers only; 0 when there is none."""
    return spark.read.parquet(path).count() if table_exists(spark, path) else 0


def audited_write(
    df: DataFrame,
    path: str,
    log: Callable[[DataFrame], None],
    job: str,
    source: str,
    target: str,
    rows_source: int | None = None,
    mode: str = "overwrite",
    operation: str = "LOAD",
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> int:
    """Start event, one parquet write, end event.

    The plan runs once; rows are counted from the written footers. (``observe`` would
    count during the write, but in Spark 4.1 it makes later model plans of the same
    session unserializable.)
    """
    spark = df.sparkSession
    started = clock()
    audit_id, row = start_event(spark, job, source, target, operation, started)
    log(row)
    try:
        before = stored_rows(spark, path) if mode == "append" else 0
        df.write.mode(mode).parquet(path)
        rows = stored_rows(spark, path) - before
    except Exception as failure:
        log(
            end_event(
                spark, audit_id, job, source, target, operation, started, clock(),
                rows_source=rows_source, error=str(failure),
            )
        )
        raise
    log(
        end_event(
            spark, audit_id, job, source, target, operation, started, clock(),
            rows_source=rows_source, rows_target=rows, rows_inserted=rows,
        )
    )
    return rows


def audited_run(
    df: DataFrame,
    path: str,
    log: Callable[[DataFrame], None],
    job: str,
    source: str,
    target: str,
    source_rows: DataFrame,
    keys: Sequence[str],
    reconcile: Callable[[DataFrame], None],
    profile: Callable[[DataFrame], None],
    as_of: str,
    mode: str = "overwrite",
) -> int:
    """Audited write, then the reconciliation with the source and a quality profile of what
    is stored, each handed to its sink. A failed write leaves only its audit events."""
    spark = df.sparkSession
    rows = audited_write(
        df, path, log, job, source, target, rows_source=source_rows.count(), mode=mode
    )
    stored = spark.read.parquet(path)
    reconcile(reconcile_counts(source_rows, stored, source, target, as_of, keys))
    profile(quality_profile(stored, target, keys, as_of))
    return rows


def _days_before(column: str, as_of: str, days: int) -> Column:
    """Not older than ``days`` days before ``as_of``."""
    return F.to_date(column) >= F.date_sub(F.to_date(F.lit(as_of)), days)


def daily_summary(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Task counts by status, row sums and durations per run date."""

    def with_status(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return (
        log.where(_days_before("start_time", as_of, days))
        .groupBy(F.to_date("start_time").alias("run_date"))
        .agg(
            F.count("*").alias("total_tasks"),
            with_status("SUCCESS").alias("successful_tasks"),
            with_status("FAILED").alias("failed_tasks"),
            with_status("PARTIAL").alias("partial_tasks"),
            F.sum("rows_inserted").alias("total_rows_inserted"),
            F.sum("rows_updated").alias("total_rows_updated"),
            F.sum("rows_deleted").alias("total_rows_deleted"),
            F.avg("duration_seconds").alias("avg_duration_seconds"),
            F.max("duration_seconds").alias("max_duration_seconds"),
        )
    )


def run_summary(daily: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row over the last days: a run date succeeds when no task of it failed."""
    return daily.where(_days_before("run_date", as_of, days)).agg(
        F.lit(int(days)).alias("period_days"),
        F.count("*").alias("total_runs"),
        F.count_if(F.col("failed_tasks") == 0).alias("successful_runs"),
        F.count_if(F.col("failed_tasks") > 0).alias("failed_runs"),
    )


def report_status(runs: DataFrame, gate_failures: DataFrame) -> DataFrame:
    """FAIL with failed runs, WARN with training-gate failures, else PASS (one row)."""
    gates = gate_failures.agg(F.count("*").alias("gate_failures"))
    status = (
        F.when(F.col("failed_runs") > 0, "FAIL")
        .when(F.col("gate_failures") > 0, "WARN")
        .otherwise("PASS")
    )
    return runs.crossJoin(F.broadcast(gates)).withColumn("report_status", status)


def daily_report(
    log: DataFrame, quality: DataFrame, reconciliation: DataFrame, report_date: str
) -> DataFrame:
    """Seven (section, metric, value) rows for one date."""
    day = F.to_date(F.lit(report_date))
    tasks = log.where(F.to_date("start_time") == day).agg(
        F.count("*").alias("Total Tasks Run"),
        F.count_if(F.col("status") == "SUCCESS").alias("Successful Tasks"),
        F.count_if(F.col("status") == "FAILED").alias("Failed Tasks"),
    )
    checked = quality.where(F.col("check_date") == day).agg(
        F.count_distinct("table_name").alias("Tables Checked"),
        F.count_if("issues_found").alias("Tables with Issues"),
    )
    compared = reconciliation.where(F.col("reconciliation_date") == day).agg(
        F.count_if(F.col("reconciliation_status") == "PASS").alias("Passed Checks"),
        F.count_if(F.col("reconciliation_status") == "FAIL").alias("Failed Checks"),
    )

    def section(one_row: DataFrame, name: str) -> DataFrame:
        text = one_row.select(*[F.col(c).cast("string").alias(c) for c in one_row.columns])
        return text.unpivot([], one_row.columns, "metric_name", "metric_value").select(
            F.lit(name).alias("report_section"), "metric_name", "metric_value"
        )

    return (
        section(tasks, "ETL Summary")
        .unionByName(section(checked, "Data Quality"))
        .unionByName(section(compared, "Reconciliation"))
    )


def failed_tasks(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Failed or retrying tasks of the last days, newest first."""
    bad = F.col("status").isin("FAILED", "RETRYING")
    return log.where(bad & _days_before("start_time", as_of, days)).orderBy(
        F.col("start_time").desc(), "audit_id"
    )


def _variance(source: Column, target: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(target - source) * 100.0, source), F.lit(0.0))


def reconcile_counts(
    source: DataFrame,
    target: DataFrame,
    source_name: str,
    target_name: str,
    as_of: str,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """One reconciliation row: both counts, difference, variance %, match, status."""
    # two one-row aggregates
    both = source.agg(F.count("*").alias("source_row_count")).crossJoin(
        F.broadcast(target.agg(F.count("*").alias("target_row_count")))
    )
    diff = F.col("target_row_count") - F.col("source_row_count")
    out = both.withColumns(
        {
            "row_count_difference": diff,
            "row_count_variance_percent": _variance(
                F.col("source_row_count"), F.col("target_row_count")
            ),
        }
    )
    v = F.col("row_count_variance_percent")
    return out.select(
        F.lit(source_name).alias("source_table"),
        F.lit(target_name).alias("target_table"),
        F.to_date(F.lit(as_of)).alias("reconciliation_date"),
        "source_row_count",
        "target_row_count",
        "row_count_difference",
        "row_count_variance_percent",
        (v < 1).alias("row_count_match"),
        F.when(v < 0.5, "PASS").when(v < 5, "WARN").otherwise("FAIL").alias(
            "reconciliation_status"
        ),
        F.array(*[F.lit(k) for k in keys or []]).cast("array<string>").alias("source_key_columns"),
    )


def reconcile_keys(
    source: DataFrame, target: DataFrame, source_keys: Sequence[str], target_keys: Sequence[str]
) -> DataFrame:
    """Distinct keys on one side only: missing from the target, orphaned in the target.

    One full join of the two key sets, which are made distinct in the map tasks first.
    """
    names = [f"k{i}" for i in range(len(source_keys))]

    def keyed(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
        picked = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        return picked.distinct().withColumn(flag, F.lit(1))

    joined = keyed(source, source_keys, "_s").join(keyed(target, target_keys, "_t"), names, "full")
    return joined.agg(
        F.count("_s").alias("source_keys"),
        F.count("_t").alias("target_keys"),
        F.count_if(F.col("_s").isNull()).alias("orphaned_records"),
        F.count_if(F.col("_t").isNull()).alias("missing_records"),
    )


def reconciliation_view(reconciliation: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Integrity verdict per reconciliation of the last days."""
    verdict = (
        F.when(F.col("row_count_match"), "PASS")
        .when(F.col("row_count_variance_percent") < 1, "WARN")
        .otherwise("FAIL")
    )
    return (
        reconciliation.where(_days_before("reconciliation_date", as_of, days))
        .withColumn("data_integrity_status", verdict)
        .orderBy(F.col("reconciliation_date").desc(), "source_table")
    )


def task_status(reconciliation: DataFrame, fail_at: float = 5.0) -> DataFrame:
    """Status of the reconcile task: match passes, below ``fail_at`` percent warns, else fails."""
    status = (
        F.when(F.col("row_count_match"), "PASS")
        .when(F.col("row_count_variance_percent") < fail_at, "WARN")
        .otherwise("FAIL")
    )
    return reconciliation.withColumn("task_status", status)


def assert_reconciled(reconciliation: DataFrame, fail_at: float = 5.0) -> None:
    """Raise when any row reaches ``fail_at`` percent variance."""
    worst = (
        task_status(reconciliation, fail_at)
        .where(F.col("task_status") == "FAIL")
        .orderBy(F.col("row_count_variance_percent").desc())
        .select("target_table", "row_count_variance_percent")
        .first()
    )
    if worst:
        raise ValueError(
            f"Reconciliation failed for {worst[0]}: {worst[1]:.1f}% variance"
        )


def lineage(events: DataFrame) -> DataFrame:
    """Source, target, rows in and out and loss percent of every finished job."""
    done = current_state(events).where(F.col("status") == "SUCCESS")
    loss = F.coalesce(
        F.try_divide((F.col("rows_source") - F.col("rows_target")) * 100.0, F.col("rows_source")),
        F.lit(0.0),
    )
    return done.select(
        "audit_id",
        "source_table",
        "target_table",
        "operation",
        F.col("rows_source").alias("rows_in"),
        F.col("rows_target").alias("rows_out"),
        loss.alias("loss_percent"),
        "end_time",
    )
