"""Data-quality profile, gate and dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbar.operators.panel import latest_per

ISSUE = "array<struct<issue:string,count:bigint,percent:double>>"


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(100.0))


def quality_profile(
    df: DataFrame,
    table_name: str,
    keys: Sequence[str],
    as_of: str,
    value_column: str | None = None,
    exact_distinct: Sequence[str] = (),
) -> DataFrame:
    """One profile row: row, key and null counts, per-column statistics, scores, issues.

    One wide aggregate for the columns, one key count. Distinct values of a column are
    sketched in the wide aggregate, except in ``exact_distinct``: exact counts expand the
    rows once per named column.
    """
    columns = df.columns
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    aggs = [F.count("*").alias("total_rows"), F.count_if(any_null).alias("null_rows")]
    for c in columns:
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"_null_{c}"),
            F.min(c).cast("string").alias(f"_min_{c}"),
            F.max(c).cast("string").alias(f"_max_{c}"),
        ]
        if c not in exact_distinct:
            aggs.append(F.approx_count_distinct(c).alias(f"_dist_{c}"))
    v = F.col(value_column).cast("double") if value_column else F.lit(None).cast("double")
    aggs += [
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
        F.stddev_samp(v).alias("stddev_value"),
    ]
    wide = df.agg(*aggs)
    # exact distinct values column by column: each merges in the map tasks on its own key
    exact = [F.count_distinct(c).alias(f"_dist_{c}") for c in columns if c in exact_distinct]
    unique = df.select(*keys).distinct().agg(F.count("*").alias("unique_rows"))
    # all of them are one row
    joined = wide.crossJoin(F.broadcast(unique))
    if exact:
        joined = joined.crossJoin(F.broadcast(df.agg(*exact)))

    total = F.col("total_rows")
    nulls = sum((F.col(f"_null_{c}") for c in columns[1:]), F.col(f"_null_{columns[0]}"))
    scored = joined.withColumns(
        {
            "duplicate_rows": total - F.col("unique_rows"),
            "null_values": nulls,
            "data_completeness_percent": F.round(
                100.0 - F.coalesce(F.try_divide(nulls * 100.0, total * len(columns)), F.lit(0.0)), 2
            ),
            "data_uniqueness_percent": F.round(_percent(F.col("unique_rows"), total), 2),
        }
    ).withColumn(
        "quality_score",
        F.round((F.col("data_completeness_percent") + F.col("data_uniqueness_percent")) / 2, 2),
    )
    score = F.col("quality_score")
    status = (
        F.when(score >= 99, "EXCELLENT")
        .when(score >= 95, "GOOD")
        .when(score >= 80, "FAIR")
        .otherwise("POOR")
    )

    def issue(name: str, count: Column) -> Column:
        return F.when(
            count > 0,
            F.struct(
                F.lit(name).alias("issue"),
                count.cast("long").alias("count"),
                F.round(F.try_divide(count * 100.0, total), 4).alias("percent"),
            ),
        )

    issues = F.array_compact(
        F.array(
            issue("null_values", F.col("null_rows")),
            issue("duplicate_rows", F.col("duplicate_rows")),
        )
    ).cast(ISSUE)
    per_column = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(
            *[
                F.struct(
                    F.col(f"_null_{c}").alias("null_count"),
                    F.coalesce(
                        F.try_divide(F.col(f"_null_{c}") * 100.0, total), F.lit(0.0)
                    ).alias("null_percent"),
                    F.col(f"_dist_{c}").alias("unique_count"),
                    F.col(f"_min_{c}").alias("min"),
                    F.col(f"_max_{c}").alias("max"),
                )
                for c in columns
            ]
        ),
    )
    return (
        scored.withColumns({"issue_details": issues, "column_quality": per_column})
        .select(
            F.lit(table_name).alias("table_name"),
            F.to_date(F.lit(as_of)).alias("check_date"),
            "total_rows",
            "unique_rows",
            "duplicate_rows",
            "null_rows",
            "column_quality",
            "data_completeness_percent",
            "data_uniqueness_percent",
            "min_value",
            "max_value",
            "mean_value",
            "stddev_value",
            (F.size("issue_details") > 0).alias("issues_found"),
            F.size("issue_details").cast("long").alias("issue_count"),
            "issue_details",
            "quality_score",
            status.alias("quality_status"),
        )
    )


def column_profile(profile: DataFrame) -> DataFrame:
    """One row per profiled column."""
    return profile.select(
        "table_name", F.explode("column_quality").alias("column_name", "_q")
    ).select("table_name", "column_name", "_q.*")


def quality_gate(
    profiles: DataFrame,
    tables: DataFrame,
    completeness: float = 95.0,
    uniqueness: float = 99.0,
) -> DataFrame:
    """Latest profile of each wanted table against the limits; NO_DATA without a profile."""
    last = latest_per(profiles, ["table_name"], ["check_date"])
    full = F.col("data_completeness_percent") >= completeness
    unique = F.col("data_uniqueness_percent") >= uniqueness
    status = F.when(F.col("total_rows").isNull(), "NO_DATA").when(full & unique, "PASS").otherwise(
        "WARN"
    )
    return tables.join(last, "table_name", "left").select(
        "table_name",
        "total_rows",
        "data_completeness_percent",
        "data_uniqueness_percent",
        "quality_score",
        "quality_status",
        "issue_count",
        full.alias("completeness_pass"),
        unique.alias("uniqueness_pass"),
        status.alias("gate_status"),
    )


def quality_dashboard(profiles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = F.col("check_date") >= F.date_sub(F.to_date(F.lit(as_of)), days)
    return profiles.where(recent).orderBy(F.col("check_date").desc(), "quality_score", "table_name")
