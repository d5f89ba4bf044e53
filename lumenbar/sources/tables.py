"""Table readers and writers: parquet, catalog and JDBC."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def jdbc_partitions(rows: int | None, cap: int | None = None) -> int:
    """Read partitions for a row count: one per sqrt(rows / 100,000), at most ``cap``.

    ``cap`` limits the connections one database gets; None is no limit.
    """
    if rows is None:
        return 3
    wanted = max(1, int(math.sqrt(rows / 100_000)))
    return wanted if cap is None else min(wanted, cap)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str = "id",
    properties: dict[str, str] | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Range-partitioned read on ``key``; one partition when the bounds are unknown."""
    props = dict(properties or {})
    bounds = f"(SELECT MIN({key}) AS LO, MAX({key}) AS HI, COUNT(*) AS N FROM {table}) b"
    row = spark.read.jdbc(url, bounds, properties=props).first()
    lo, hi, n = row if row else (None, None, None)
    if lo is None or hi is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(
        url,
        table,
        column=key,
        lowerBound=int(lo),
        upperBound=int(hi) + 1,
        numPartitions=jdbc_partitions(int(n), cap),
        properties=props,
    )


def cast_prices(df: DataFrame, columns: Sequence[str] = ("high", "low", "close")) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def table_exists(spark: SparkSession, name: str) -> bool:
    """A catalog table, or a parquet folder when the name is a path."""
    if "/" in name:
        try:
            spark.read.parquet(name)
        except AnalysisException:
            return False
        return True
    return spark.catalog.tableExists(name)


def read_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows of ``schema`` when it does not exist."""
    if not table_exists(spark, name):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def column_or(df: DataFrame, name: str, otherwise):
    """The column when the frame has it, else the fallback expression."""
    return F.col(name) if name in df.columns else otherwise


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def overwrite(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    source: DataFrame | None = None,
) -> bool:
    """Replace a parquet table; with an empty ``source`` nothing is written.

    The guard looks at the raw source, so the derived plan runs once. Output files are
    sized by the rebalance hint, not by a fixed partition count.
    """
    if source is not None and source.isEmpty():
        return False
    writer = df.hint("rebalance").write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return True


def overwrite_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    source: DataFrame | None = None,
    batch_size: int = 5000,
) -> bool:
    """Replace a database table, keeping its definition (truncate), in batches."""
    if source is not None and source.isEmpty():
        return False
    props = {**(properties or {}), "batchsize": str(batch_size), "truncate": "true"}
    df.write.jdbc(url, table, mode="overwrite", properties=props)
    return True


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """Smallest and largest key and the row count, for sizing a partitioned read."""
    return df.agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("row_count")
    )
