"""Forward-return labels, eligibility filters and chronological cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.functions.nulls import finite_or_null
from lumenbar.operators.panel import is_daily, per_series
from lumenbar.schemas import FEATURES, Horizon


def forward_close(df: DataFrame, bars_ahead: int, **segmenting) -> DataFrame:
    """Adds the close ``bars_ahead`` rows later as ``future_close``."""

    def compute(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("event_time")
        return d.withColumn("future_close", F.lead("close", bars_ahead).over(w))

    return per_series(df, compute, lookback=0, lookahead=bars_ahead, **segmenting)


def training_rows(
    df: DataFrame, horizon: Horizon, features: Sequence[str] = FEATURES, **segmenting
) -> DataFrame:
    """Labelled rows with every feature present."""
    labelled = forward_close(df, horizon.bars_ahead, **segmenting)
    kept = labelled.dropna(subset=["future_close", *features])
    return kept.withColumn(
        "target", (F.col("future_close") > F.col("close") * horizon.gain).cast("int")
    )


def validation_rows(
    df: DataFrame, horizon: Horizon, features: Sequence[str] = FEATURES, **segmenting
) -> DataFrame:
    """Training rows with positive prices, an event date and a finite realized return."""
    rows = training_rows(df, horizon, features, **segmenting)
    ratio = F.try_divide(F.col("future_close"), F.col("close")) - 1
    return (
        rows.where((F.col("close") > 0) & (F.col("future_close") > 0))
        .withColumns(
            {"event_date": F.to_date("event_time"), "realized_return": finite_or_null(ratio)}
        )
        .dropna(subset=["realized_return"])
    )


def training_profile(df: DataFrame) -> DataFrame:
    """Rows, distinct symbols, positive rate."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("symbol").alias("symbol_count"),
        F.avg(F.col("target").cast("double")).alias("positive_rate"),
    )


def first_rows_filter(df: DataFrame, count: int, time: str = "event_time") -> Column:
    """Predicate that keeps the first ``count`` rows in (time, symbol, row hash) order.

    It is never NULL: rows without a time are the oldest, rows without a symbol the first
    of their time, so every row is on one side of a cut. Rows that repeat time and symbol
    are told apart by a hash of the whole row; only rows equal in every column stay
    together.

    No global sort: rows are counted per day, then (timestamps only) per hour, minute and
    second of the one slice the cut falls in, and only that last slice is ordered. The
    driver sees one count per calendar day and at most 60 counts per finer step. The
    result is a filter of literals, so give a stored frame that is read repeatedly.
    """
    t, symbol = F.col(time), F.col("symbol")
    whole_row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    daily = is_daily(df, time)
    left, inside, here = count, F.lit(False), F.lit(True)
    for step in ["day"] if daily else ["day", "hour", "minute", "second"]:
        # a bare date column can be filtered in the scan
        unit = t if daily else F.date_trunc(step, t)
        boundary, found = None, False
        sizes = df.where(here).groupBy(unit.alias("u")).agg(F.count("*")).orderBy("u")
        for at, n in sizes.collect():
            if n > left:
                boundary, found = at, True
                break
            left -= n
        if not found:
            return F.lit(True)
        inside = inside | (here & _before(unit, boundary))
        here = here & _same(unit, boundary)
        if left == 0:
            return inside
        if boundary is None:
            break
    in_order = Window.partitionBy(unit).orderBy(t, symbol, whole_row)
    last = (
        df.where(here)
        .select(t, symbol, whole_row, F.row_number().over(in_order).alias("_rn"))
        .where(F.col("_rn") == left)
        .first()
    )
    tied = _same(symbol, last[1]) & (whole_row <= F.lit(last[2]))
    return inside | (
        here & (_before(t, last[0]) | (_same(t, last[0]) & (_before(symbol, last[1]) | tied)))
    )


def _before(c: Column, value) -> Column:
    """Strictly before ``value``, NULL first."""
    return F.lit(False) if value is None else F.coalesce(c < F.lit(value), F.lit(True))


def _same(c: Column, value) -> Column:
    return c.isNull() if value is None else F.coalesce(c == F.lit(value), F.lit(False))


def most_recent(df: DataFrame, rows: int, time: str = "event_time") -> DataFrame:
    """The last ``rows`` rows in (time, symbol) order."""
    surplus = df.count() - int(rows)
    return df if surplus <= 0 else df.where(~first_rows_filter(df, surplus, time))


def chronological_split(
    df: DataFrame, fraction: float = 0.8, time: str = "event_time"
) -> tuple[DataFrame, DataFrame]:
    """First ``fraction`` of the rows by (time, symbol), and the rest."""
    first = first_rows_filter(df, int(df.count() * fraction), time)
    return df.where(first), df.where(~first)
