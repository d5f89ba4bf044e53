"""Incremental filters, keyed merges and snapshot differences."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbar.operators.panel import latest_per
from lumenbar.schemas import INGEST_START_DATE
from lumenbar.session import checkpoint_folder
from lumenbar.sources.tables import table_exists


def watermarks(existing: DataFrame, symbol: str = "symbol", time: str = "event_time") -> DataFrame:
    return existing.groupBy(symbol).agg(F.max(time).alias("watermark"))


def advance_watermarks(
    ledger: DataFrame, batch: DataFrame, symbol: str = "symbol", time: str = "event_time"
) -> DataFrame:
    """The ledger (a row per symbol) after a merged batch: the later of old and new.

    A late batch moves no mark back. Reads the ledger and the batch, never the history.
    """
    both = ledger.select(symbol, "watermark").unionByName(watermarks(batch, symbol, time))
    return both.groupBy(symbol).agg(F.max("watermark").alias("watermark"))


def newer_than_watermark(
    incoming: DataFrame,
    existing: DataFrame,
    inclusive: bool = False,
    start_date: str = INGEST_START_DATE,
    symbol: str = "symbol",
    time: str = "event_time",
) -> DataFrame:
    """Rows past each symbol's watermark; unseen symbols keep rows from ``start_date``.

    ``inclusive`` also keeps the watermark day itself, compared by date.
    """
    marks = watermarks(existing, symbol, time)
    return newer_than_marks(incoming, marks, inclusive, start_date, symbol, time)


def newer_than_marks(
    incoming: DataFrame,
    marks: DataFrame,
    inclusive: bool = False,
    start_date: str = INGEST_START_DATE,
    symbol: str = "symbol",
    time: str = "event_time",
) -> DataFrame:
    """`newer_than_watermark` from a ledger of watermarks kept by the merges before."""
    joined = incoming.join(marks, symbol, "left")
    day = F.to_date(time)
    if inclusive:
        fresh = day >= F.to_date("watermark")
    else:
        fresh = F.col(time) > F.col("watermark")
    unseen = F.col("watermark").isNull() & (day >= F.to_date(F.lit(start_date)))
    return joined.where(fresh | unseen).drop("watermark")


def one_per_key(
    incoming: DataFrame, keys: Sequence[str], newest_by: str | None = None
) -> DataFrame:
    """Incoming rows with each key once: the newest by a column, else the largest row."""
    rest = [c for c in incoming.columns if c not in keys]
    order = ([newest_by] if newest_by else []) + [c for c in rest if c != newest_by]
    return latest_per(incoming, keys, order or list(keys))


def insert_only(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed upsert that ignores rows whose key exists."""
    keys = list(keys)
    fresh = one_per_key(incoming, keys).join(
        existing.select(*keys), keys, "left_anti"
    )
    return existing.unionByName(fresh, allowMissingColumns=True)


def update_columns(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    newest_by: str | None = None,
) -> DataFrame:
    """Keyed upsert that overwrites only ``columns`` of existing rows."""
    keys = list(keys)
    incoming = one_per_key(incoming, keys, newest_by)
    every = [c for c in existing.columns if c not in keys]
    new = incoming.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in every if c in incoming.columns],
        F.lit(True).alias("_in"),
    )
    old = existing.withColumn("_had", F.lit(True))
    joined = old.join(new, keys, "full")

    def pick(c: str):
        if c not in incoming.columns:
            return F.col(c)
        fresh = F.col("_had").isNull()
        if c in columns:
            fresh = fresh | F.col("_in").isNotNull()
        return F.when(fresh, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *[pick(c) for c in every]).select(*existing.columns)


def replace_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], newest_by: str | None = None
) -> DataFrame:
    """Keyed upsert that replaces whole rows; columns may be added."""
    keys = list(keys)
    incoming = one_per_key(incoming, keys, newest_by)
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def merge_partitions(
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    partition: str,
    newest_by: str | None = None,
) -> int:
    """Replacing upsert into a parquet table partitioned by ``partition`` (one of the keys).

    Only partitions that ``incoming`` touches are read and rewritten; the others keep their
    files. The merged rows are written beside the table first, in the shared folder, and
    swapped in from there, so a failure before the swap leaves the table as it was, and the
    table is never read by the job that overwrites it. Returns the partitions written.

    Partitions are folders named by value here, for tables that other readers list;
    `sources.versioned` keeps them in a manifest.
    """
    if partition not in keys:
        raise ValueError("the partition column must be one of the keys")
    spark = incoming.sparkSession
    # one value per calendar day or other partition
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    if not touched:
        return 0
    if table_exists(spark, path):
        # All files' columns, and the partition in the type of the incoming rows: its values
        # are read from folder names, where "001" would pass for a number.
        found = spark.read.option("mergeSchema", "true").parquet(path).schema
        kinds = [incoming.schema[f.name] if f.name == partition else f for f in found]
        stored = spark.read.schema(T.StructType(kinds)).parquet(path)
        column = F.col(partition)
        known = [v for v in touched if v is not None]
        here = column.isin(known) if len(known) == len(touched) else column.isin(known) | column.isNull()
        merged = replace_rows(stored.where(here), incoming, keys, newest_by)
    else:
        merged = one_per_key(incoming, keys, newest_by)
    staged = f"{checkpoint_folder(spark)}/merge-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    (
        spark.read.parquet(staged)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    return len(touched)


def evolve(df: DataFrame, target: DataFrame) -> DataFrame:
    """Add the columns of ``target`` that ``df`` lacks, as NULL."""
    return df.unionByName(target.limit(0), allowMissingColumns=True)


def deduplicate(df: DataFrame, keys: Sequence[str], newest_by: str) -> DataFrame:
    """One row per key, the newest by a column."""
    return latest_per(df, keys, [newest_by])


def change_log(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-level differences of two snapshots: operation, changed columns, old / new JSON."""
    keys = list(keys)
    values = [c for c in before.columns if c not in keys]
    old = before.select(*keys, F.struct(*values).alias("_old"))
    new = after.select(*keys, F.struct(*values).alias("_new"))
    changed = F.array_compact(
        F.array(
            *[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in values]
        )
    )
    operation = (
        F.when(F.col("_old").isNull(), "INSERT")
        .when(F.col("_new").isNull(), "DELETE")
        .when(F.size("changed_columns") > 0, "UPDATE")
    )
    return (
        old.join(new, keys, "full")
        .withColumn(
            "changed_columns",
            F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), changed).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .withColumn("operation", operation)
        .where(F.col("operation").isNotNull())
        .select(
            *keys,
            "operation",
            "changed_columns",
            F.to_json("_old").alias("old_values"),
            F.to_json("_new").alias("new_values"),
        )
    )
