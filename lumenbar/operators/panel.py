"""Panel time series: one row per (symbol, event_time).

Rolling operators partition by symbol. A series keyed by DATE has at most one row
per calendar day, so a century is under 37,000 rows and a symbol fits in one
task whatever the size of the table. A series keyed by TIMESTAMP has no such bound:
there one symbol may hold a large share of all rows, so ``per_series`` cuts long
series into segments, copies the few neighbouring rows a frame can reach, and
keeps only the rows each segment owns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "_segment"
ROWS_PER_SEGMENT = 1_000_000
BUCKETS = ["day", "hour", "minute", "second"]

Compute = Callable[[DataFrame, list[str]], DataFrame]


def is_daily(df: DataFrame, time: str = "event_time") -> bool:
    return isinstance(df.schema[time].dataType, T.DateType)


def per_series(
    df: DataFrame,
    compute: Compute,
    lookback: int,
    lookahead: int = 0,
    symbol: str = "symbol",
    time: str = "event_time",
    rows_per_segment: int = ROWS_PER_SEGMENT,
    bucket: str = "day",
) -> DataFrame:
    """Run ``compute(df, partition_columns)`` over every series.

    ``lookback`` / ``lookahead``: how many rows before / after a row ``compute``
    may read. A NULL symbol is a series of its own and a NULL time comes first in its
    series, for dates and timestamps alike.
    """
    if is_daily(df, time):
        return compute(df, [symbol])
    segmented = split_series(
        df, lookback, lookahead, symbol, time, rows_per_segment=rows_per_segment, bucket=bucket
    )
    return compute(segmented, [symbol, SEGMENT]).where("_owned").drop(SEGMENT, "_owned")


def split_series(
    df: DataFrame,
    lookback: int,
    lookahead: int,
    symbol: str = "symbol",
    time: str = "event_time",
    rows_per_segment: int = ROWS_PER_SEGMENT,
    bucket: str = "day",
) -> DataFrame:
    """Adds ``_segment`` and ``_owned``; rows near a cut are copied to the neighbour.

    Row counts per (symbol, time bucket) are pre-aggregated in the map tasks; only
    that count table is ordered per symbol. A segment is a run of whole buckets, so the
    bucket is refined, down to seconds, until none holds more rows than a segment.
    """
    if rows_per_segment < max(lookback, lookahead, 1):
        raise ValueError("a segment must hold at least as many rows as a frame reaches")
    for unit in BUCKETS[BUCKETS.index(bucket) :]:
        rows = df.withColumn("_bucket", F.date_trunc(unit, F.col(time)))
        fullest = rows.groupBy(symbol, "_bucket").count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= rows_per_segment:
            break
    by_bucket = Window.partitionBy(symbol).orderBy("_bucket")
    counts = (
        rows.groupBy(symbol, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(by_bucket))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn(SEGMENT, F.floor(F.col("_start") / F.lit(rows_per_segment)))
    )
    by_segment = Window.partitionBy(symbol).orderBy(SEGMENT)
    segments = counts.groupBy(symbol, SEGMENT).agg(
        F.min("_start").alias("_seg_start"), F.max("_end").alias("_seg_end")
    )
    # Segment numbers grow by at least one per ``rows_per_segment`` rows, so a frame
    # never reaches past the second neighbour.
    neighbours = []
    for step in (1, 2):
        for name, move, edge in (("_next", F.lead, "_seg_start"), ("_prev", F.lag, "_seg_end")):
            neighbours.append((f"{name}{step}", move(SEGMENT, step).over(by_segment)))
            neighbours.append((f"{name}{step}_edge", move(edge, step).over(by_segment)))
    segments = segments.withColumns(dict(neighbours)).drop("_seg_start", "_seg_end")
    targets = [F.col(SEGMENT)]
    for step in (1, 2):
        targets.append(
            F.when(
                F.col(f"_next{step}_edge") - F.col("_end") < lookback, F.col(f"_next{step}")
            )
        )
        targets.append(
            F.when(
                F.col("_start") - F.col(f"_prev{step}_edge") < lookahead, F.col(f"_prev{step}")
            )
        )
    segments = segments.select(
        F.col(symbol).alias("_s"), F.col(SEGMENT).alias("_g"), *segments.columns[2:]
    )
    plan = counts.join(
        segments, F.col(symbol).eqNullSafe(F.col("_s")) & (F.col(SEGMENT) == F.col("_g"))
    ).select(
        F.col(symbol).alias("_p_symbol"),
        F.col("_bucket").alias("_p_bucket"),
        F.col(SEGMENT).alias("_home"),
        F.array_compact(F.array(*targets)).alias("_to"),
    )
    here = F.col(symbol).eqNullSafe(F.col("_p_symbol")) & F.col("_bucket").eqNullSafe(
        F.col("_p_bucket")
    )
    return (
        rows.join(plan, here)
        .withColumn(SEGMENT, F.explode("_to"))
        .withColumn("_owned", F.col(SEGMENT) == F.col("_home"))
        .drop("_bucket", "_home", "_to", "_p_symbol", "_p_bucket")
    )


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``. Each map task keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def symbol_history(df: DataFrame, symbol: str) -> DataFrame:
    """One symbol in time order; the filter reaches the scan."""
    return df.where(F.col("symbol") == symbol).orderBy("event_time")


def growth_as_of(
    df: DataFrame,
    years: Sequence[int] = (1, 3, 5, 10),
    symbol: str = "symbol",
    time: str = "event_time",
) -> DataFrame:
    """Growth in percent from the last close at or before latest - n years, per symbol.

    As-of join as one aggregate: every target date is a column of the latest row, and
    ``max_by`` combines in the map tasks, so a long series is never gathered.
    """
    day = F.to_date(time)
    last = latest_per(df.select(symbol, time, "close"), [symbol], [time]).select(
        F.col(symbol), day.alias("latest_date"), F.col("close").alias("latest_close")
    )
    past = []
    for n in years:
        reached = day <= F.add_months("latest_date", -12 * n)
        past.append(
            F.max_by("close", F.when(reached, F.col(time))).alias(f"_past_{n}y")
        )
    out = (
        df.select(symbol, time, "close")
        .join(last, symbol)
        .groupBy(symbol, "latest_date", "latest_close")
        .agg(*past)
    )
    growth = {
        f"growth_{n}y": F.try_divide(F.col("latest_close") - F.col(f"_past_{n}y"), F.col(f"_past_{n}y"))
        * 100
        for n in years
    }
    return out.withColumns(growth).drop(*[f"_past_{n}y" for n in years])
