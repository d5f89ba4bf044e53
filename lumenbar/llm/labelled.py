"""Labelled training rows: a bounded, seeded sample joined to its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbar.llm.common import crc_fold


def label_sample(
    labels: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    max_rows: int = 20_000,
    held_out_fold: int | None = 0,
) -> DataFrame:
    """(label_id, label) of about ``max_rows`` labelled ids at most, chosen by hash.

    Rows without a label or id are no examples; an id with several labels takes their
    rounded mean. Ids of the held-out fold never enter.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out_fold is not None:
        given = given.where(crc_fold(id_col) != held_out_fold)
    total = given.count()
    if total > max_rows:
        share = max_rows / total
        draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1_000_003)) / 1_000_003
        given = given.where(draw < share)
    return given.groupBy(F.col(id_col).alias("label_id")).agg(
        F.round(F.avg(label_col)).cast("double").alias("label")
    )


def labelled(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of the sample. The sample's size is bounded by its parameter."""
    return docs.join(F.broadcast(sample), F.col(id_col) == F.col("label_id"))
