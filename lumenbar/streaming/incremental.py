"""Incremental bar ingest: rows of new files whose key is not stored yet are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenbar.operators.panel import latest_per
from lumenbar.schemas import BAR_SCHEMA
from lumenbar.sources.payloads import normalise_ohlcv
from lumenbar.sources.tables import append, read_or_empty

KEYS = ["symbol", "event_time"]


def merge_batch(target: str):
    """``foreachBatch`` function: insert-only merge by key.

    Only the keys of stored bars from the batch's first day on are read (the date
    filter reaches the scan), and only new rows are written, so a replayed batch
    adds nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = normalise_ohlcv(batch).select(*BAR_SCHEMA.names)
        first_day = rows.agg(F.min("event_time")).first()[0]
        if first_day is None:
            return
        stored = (
            read_or_empty(batch.sparkSession, target, BAR_SCHEMA)
            .where(F.col("event_time") >= F.lit(first_day))
            .select(*KEYS)
        )
        values = [c for c in BAR_SCHEMA.names if c not in KEYS]
        append(latest_per(rows, KEYS, values).join(stored, KEYS, "left_anti"), target)

    return merge


def ingest_new_files(
    spark: SparkSession, folder: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Merges the files not seen before, then stops (``availableNow``)."""
    stream = spark.readStream.schema(BAR_SCHEMA).parquet(folder)
    return (
        stream.writeStream.foreachBatch(merge_batch(target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
