"""Features of appended bars from a small state per symbol, without reading the history.

The state of a symbol is one row: its last 199 bars (no frame reaches further back), and the
values its exponential averages had at the last of them. An append joins the state with the
new bars, computes their features and gives the state behind them. Averages go on from the
state's values as if these were the first of the series, so that the result equals a run over
the whole history.

Defined results: a bar whose symbol or time is NULL, or whose time is not past its symbol's
last, is no append: ``late_bars`` returns it, and the features of its symbol need a full run
from that time. Of bars that repeat a key the highest close stays. An unknown symbol starts a
series. An empty batch leaves the state as it is.

All bars of one symbol and batch meet in one task: at most one a day for daily series.
Timestamped backfills belong to ``all_indicators``, which cuts long series into segments.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.operators.indicators import (
    BLOCK,
    OFFSET,
    add_emas,
    add_oscillators,
    add_price_bands,
    block_rows,
    series_window,
)
from lumenbar.operators.merge import deduplicate
from lumenbar.operators.nav import nav_features
from lumenbar.schemas import FEATURES, NAV_FEATURES
from lumenbar.session import scratch
from lumenbar.sources.versioned import VersionedTable

TAIL = 199
PRICES = ("open", "high", "low", "close", "volume")
#: carried averages: name -> (what it averages, span)
CARRIED = {"ema_12": ("close", 12), "ema_20": ("close", 20), "ema_26": ("close", 26)}
SIGNAL_SPAN = 9
#: Files the stored state is dealt to, by a hash of the symbol.
BUCKETS = 64


class Appended(NamedTuple):
    features: DataFrame
    state: DataFrame


def _prices(df: DataFrame) -> list[str]:
    return [c for c in PRICES if c in df.columns]


def known_ends(state: DataFrame) -> DataFrame:
    return state.select("symbol", F.col("last_time"))


def late_bars(state: DataFrame | None, bars: DataFrame) -> DataFrame:
    """Bars that cannot be appended: without a key, or not past their symbol's last."""
    keyless = F.col("symbol").isNull() | F.col("event_time").isNull()
    if state is None:
        return bars.where(keyless)
    beside = bars.join(known_ends(state), "symbol", "left")
    return beside.where(keyless | (F.col("event_time") <= F.col("last_time"))).drop("last_time")


def _joined(state: DataFrame | None, bars: DataFrame) -> DataFrame:
    """New bars behind the stored ones of their symbols; ``_new`` tells them apart."""
    names = _prices(bars)
    fresh = deduplicate(bars, ["symbol", "event_time"], "close").where(
        F.col("symbol").isNotNull() & F.col("event_time").isNotNull()
    )
    carries = [f"_at_{c}" for c in (*CARRIED, "signal")]
    columns = ["symbol", "event_time", *names]
    if state is None:
        none = {c: F.lit(None).cast("double") for c in carries}
        return fresh.select(*columns).withColumns({**none, "_new": F.lit(True), "_old": F.lit(0)})
    touched = fresh.select("symbol").distinct()
    before = state.join(touched, "symbol", "left_semi")
    ends = before.select(
        "symbol", "last_time", *[F.col(c[4:]).alias(c) for c in carries], F.size("tail").alias("_old")
    )
    new = fresh.select(*columns).join(ends, "symbol", "left")
    new = new.where(F.col("last_time").isNull() | (F.col("event_time") > F.col("last_time")))
    new = new.withColumns({"_new": F.lit(True), "_old": F.coalesce("_old", F.lit(0))})
    old = before.select(
        "symbol", "last_time", *[F.col(c[4:]).alias(c) for c in carries],
        F.size("tail").alias("_old"), F.explode("tail").alias("b"),
    )
    kinds = dict(fresh.dtypes)
    old = old.select(
        "symbol",
        F.col("b.event_time").alias("event_time"),
        *[F.col(f"b.{c}").cast(kinds[c]).alias(c) for c in names],
        "last_time", *carries, F.lit(False).alias("_new"), "_old",
    )
    return new.unionByName(old).drop("last_time")


def _averages(df: DataFrame) -> DataFrame:
    """ema_12, ema_20, ema_26, macd and its signal line, carried on from the state.

    The last stored bar has position 0 and stands for the averages so far; the bars before it
    have no value. A new series starts at its own first bar.
    """
    rows = block_rows(26, SIGNAL_SPAN)
    keys = ["symbol"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("event_time")) - 1
    position = number - F.greatest(F.col("_old") - 1, F.lit(0))
    df = df.withColumn("_pos", position).withColumns(
        {BLOCK: F.floor(F.col("_pos") / rows), OFFSET: F.pmod("_pos", F.lit(rows))}
    )
    seed = ~F.col("_new") & (F.col("_pos") == 0)

    def going_on(carry: str, value: Column) -> Column:
        return F.when(F.col("_new"), value).when(seed, F.col(f"_at_{carry}"))

    df = df.withColumns({f"_in_{c}": going_on(c, F.col(column)) for c, (column, _) in CARRIED.items()})
    df = add_emas(df, keys, {c: (f"_in_{c}", span) for c, (_, span) in CARRIED.items()}, rows)
    df = df.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    df = df.withColumn("_in_signal", going_on("signal", F.col("macd")))
    df = add_emas(df, keys, {"signal": ("_in_signal", SIGNAL_SPAN)}, rows)
    return df.withColumn("macd_signal", F.col("signal"))


def append_features(state: DataFrame | None, bars: DataFrame, is_fund: bool = False) -> Appended:
    """Features of the new bars, and one state row for each symbol of the batch."""
    rows = _averages(_joined(state, bars))
    window = series_window(["symbol"])
    rows = add_oscillators(add_price_bands(rows, window), window)
    wanted = list(FEATURES)
    if is_fund:
        rows, wanted = nav_features(rows), [*FEATURES, *NAV_FEATURES]
    names = _prices(bars)
    features = rows.where("_new").select("symbol", "event_time", *names, *wanted)
    newest = Window.partitionBy("symbol").orderBy(F.col("event_time").desc())
    last = rows.withColumn("_turn", F.row_number().over(newest)).where(F.col("_turn") <= TAIL)
    after = last.groupBy("symbol").agg(
        F.max("event_time").alias("last_time"),
        *[F.max_by(c, "event_time").alias(c) for c in (*CARRIED, "signal")],
        F.array_sort(F.collect_list(F.struct("event_time", *names))).alias("tail"),
        F.max("_new").alias("_moved"),
    )
    return Appended(features, after.where("_moved").drop("_moved"))


def run_append(
    bars: DataFrame, silver: VersionedTable, state: VersionedTable, is_fund: bool = False
) -> int:
    """Appends a batch to stored features and state; returns the bars appended.

    Features are written first: a run that fails in between can be repeated, it computes the
    same rows from the same state. A batch that is already in adds nothing.
    """
    known = state.read().drop("_bucket") if state.exists() else None
    with scratch(bars.sparkSession) as held:
        found = append_features(known, bars, is_fund)
        features, after = held.store(found.features), held.store(found.state)
        rows = features.count()
        if rows:
            day = F.to_date("event_time")
            silver.merge(features.withColumn("event_date", day), ["symbol", "event_time", "event_date"], ["event_date"])
            bucket = F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int")
            state.merge(after.withColumn("_bucket", bucket), ["symbol", "_bucket"], ["_bucket"])
    return rows
