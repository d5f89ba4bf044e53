"""Walk-forward splits and leakage checks, worked out on the calendar, not on the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walk_forward_splits(
    df: DataFrame,
    min_train_days: int = 504,
    test_days: int = 126,
    step_days: int = 63,
    date: str = "event_date",
) -> DataFrame:
    """Expanding splits: split, train_end, test_start, test_end.

    Train is everything up to ``train_end``; only full test windows are kept. The
    ordered window runs over distinct dates: one row per calendar day.
    """
    along = Window.orderBy(date)
    calendar = df.select(date).distinct().withColumns(
        {
            "_seen": F.row_number().over(along),
            "test_start": F.lead(date, 1).over(along),
            "test_end": F.lead(date, test_days).over(along),
        }
    )
    steps = F.col("_seen") - min_train_days
    return calendar.where(
        (steps >= 0) & (steps % step_days == 0) & F.col("test_end").isNotNull()
    ).select(
        (F.floor(steps / step_days) + 1).cast("int").alias("split"),
        F.col(date).alias("train_end"),
        "test_start",
        "test_end",
    )


def split_calendar(df: DataFrame, splits: DataFrame, date: str = "event_date") -> DataFrame:
    """One row per (split, test date): at most test_days / step_days rows per calendar day."""
    days = df.select(date).distinct()
    return days.join(
        F.broadcast(splits),
        (F.col(date) >= F.col("test_start")) & (F.col(date) <= F.col("test_end")),
    ).select("split", date)


def test_rows(df: DataFrame, splits: DataFrame, date: str = "event_date") -> DataFrame:
    """Every row joined to the splits that test it (overlapping splits repeat rows).

    An equi-join on the date; the broadcast side is bounded by the calendar.
    """
    return df.join(F.broadcast(split_calendar(df, splits, date)), date)


def leakage_checks(
    df: DataFrame,
    splits: DataFrame,
    date: str = "event_date",
    target: str | None = None,
    embargo_days: int = 0,
) -> DataFrame:
    """Per split: row counts, last train / first test date, overlapping keys, violation flag.

    Rows are counted once per date; the range join then runs over dates and splits.
    ``embargo_days`` drops that many calendar days before ``test_start`` from train.
    """
    label = F.col(target).cast("long") if target else F.lit(None).cast("long")
    per_date = df.groupBy(date).agg(
        F.count("*").alias("_rows"),
        F.count_distinct("symbol").alias("_keys"),
        F.sum(label).alias("_pos"),
    )
    day = F.col(date)
    train = (day <= F.col("train_end")) & (day < F.date_sub("test_start", embargo_days))
    test = (day >= F.col("test_start")) & (day <= F.col("test_end"))
    checked = (
        per_date.join(F.broadcast(splits), train | test)
        .groupBy("split", "train_end", "test_start", "test_end")
        .agg(
            F.coalesce(F.sum(F.when(train, F.col("_rows"))), F.lit(0)).alias("train_rows"),
            F.coalesce(F.sum(F.when(test, F.col("_rows"))), F.lit(0)).alias("test_rows"),
            F.coalesce(F.sum(F.when(train, F.col("_pos"))), F.lit(0)).alias("train_positives"),
            F.max(F.when(train, day)).alias("train_max_date"),
            F.min(F.when(test, day)).alias("test_min_date"),
            F.coalesce(F.sum(F.when(train & test, F.col("_keys"))), F.lit(0)).alias(
                "overlap_rows"
            ),
        )
    )
    violation = F.coalesce(F.col("train_max_date") >= F.col("test_min_date"), F.lit(True))
    return checked.withColumn("date_violation", violation)


def key_overlap(
    train: DataFrame, test: DataFrame, keys: tuple[str, ...] = ("symbol", "event_date")
) -> DataFrame:
    """Number of distinct keys two frames share (for splits not made of date ranges)."""
    shared = train.select(*keys).intersect(test.select(*keys))
    return shared.agg(F.count("*").alias("overlap_rows"))
