"""Exact quantiles without gathering a column, and the operators built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.functions.nulls import finite_or_null

# Bins per e-fold of magnitude: a bin is about 0.006 % wide.
BINS_PER_E = 16384


def order_bin(value: Column, bins_per_e: int = BINS_PER_E) -> Column:
    """Order-preserving integer bin of a double, logarithmic in its magnitude.

    The number of bins depends on the range of a double (under 24 million), not on rows.
    """
    magnitude = F.log1p(F.abs(value) * 1e6) * bins_per_e
    return F.floor(F.when(value < 0, -magnitude).otherwise(magnitude))


def unpivot_values(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """One (feature, value) row per finite value."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "feature", "value"
    )
    return long.where(finite_or_null(F.col("value")).isNotNull())


def exact_quantiles(
    long: DataFrame,
    probs: Sequence[float],
    keys: Sequence[str] = ("feature",),
    weight: str | None = None,
    counts: DataFrame | None = None,
    bins_per_e: int = BINS_PER_E,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per key: columns ``n`` and ``q`` (array).

    ``weight`` names a column of row counts when equal values are already merged;
    ``counts`` is a histogram kept elsewhere (keys, ``_bin``, ``_n``) in bins of ``bins_per_e``.
    Two passes: a histogram finds the bins holding the wanted ranks, then only the
    rows of those bins are counted per value and ranked. Both passes combine in the
    map tasks. The bin list (keys x two ranks per quantile) is broadcast: it does not
    grow with the rows.
    """
    keys = list(keys)
    rows = F.sum(weight) if weight else F.count("*")
    binned = long.withColumn("_bin", order_bin(F.col("value"), bins_per_e))
    along = Window.partitionBy(*keys).orderBy("_bin")
    if counts is None:
        counts = binned.groupBy(*keys, "_bin").agg(rows.alias("_n"))
    histogram = counts.withColumns(
        {"_end": F.sum("_n").over(along), "n": F.sum("_n").over(Window.partitionBy(*keys))}
    ).withColumn("_start", F.col("_end") - F.col("_n"))

    def rank(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    lows, highs = ([f(rank(p)).cast("long") for p in probs] for f in (F.floor, F.ceil))
    wanted = F.array_distinct(F.array(*lows, *highs))
    holds = F.exists(wanted, lambda r: (r >= F.col("_start")) & (r < F.col("_end")))
    needed = histogram.where(holds).select(*keys, "_bin", "n", "_start")

    in_bin = Window.partitionBy(*keys, "_bin").orderBy("value")
    ranked = (
        binned.join(F.broadcast(needed), [*keys, "_bin"])
        .groupBy(*keys, "_bin", "n", "_start", "value")
        .agg(rows.alias("_n"))
        .withColumn("_to", F.col("_start") + F.sum("_n").over(in_bin))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )

    def value_at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("value")))

    picked = ranked.groupBy(*keys, "n").agg(
        *[value_at(r).alias(f"_lo{i}") for i, r in enumerate(lows)],
        *[value_at(r).alias(f"_hi{i}") for i, r in enumerate(highs)],
    )

    def interpolate(i: int, p: float) -> Column:
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return low + (high - low) * (rank(p) - F.floor(rank(p)))

    return picked.select(
        *keys, "n", F.array(*[interpolate(i, p) for i, p in enumerate(probs)]).alias("q")
    )


def _bounds(df: DataFrame, features: Sequence[str], low: float, high: float) -> DataFrame:
    """One row: ``_lo_<feature>`` and ``_hi_<feature>``."""
    q = exact_quantiles(unpivot_values(df, features), [low, high])
    picks = []
    for f in features:
        here = F.col("feature") == f
        picks.append(F.max(F.when(here, F.col("q")[0])).alias(f"_lo_{f}"))
        picks.append(F.max(F.when(here, F.col("q")[1])).alias(f"_hi_{f}"))
    return q.agg(*picks)


def winsorize(
    df: DataFrame, features: Sequence[str], low: float = 0.005, high: float = 0.995
) -> DataFrame:
    """Clip each feature to its global quantiles; missing stays missing."""
    features = [f for f in features if f in df.columns]
    bounded = df.crossJoin(F.broadcast(_bounds(df, features, low, high)))
    clipped = {
        f: F.when(
            F.col(f).isNotNull(), F.least(F.greatest(f, F.col(f"_lo_{f}")), F.col(f"_hi_{f}"))
        )
        for f in features
    }
    return bounded.withColumns(clipped).select(*df.columns)


def outlier_rate(
    df: DataFrame, features: Sequence[str], low: float = 0.001, high: float = 0.999
) -> DataFrame:
    """One row ``outlier_rate``: mean over features of the share outside the quantiles.

    Missing values count as inside; an empty frame gives 0.
    """
    features = [f for f in features if f in df.columns]
    if not features:
        return df.sparkSession.createDataFrame([(0.0,)], "outlier_rate double")
    bounded = df.crossJoin(F.broadcast(_bounds(df, features, low, high)))
    shares = bounded.agg(
        *[
            F.avg(
                F.when((F.col(f) < F.col(f"_lo_{f}")) | (F.col(f) > F.col(f"_hi_{f}")), 1.0)
                .otherwise(0.0)
            ).alias(f)
            for f in features
        ]
    )
    mean = sum((F.col(f) for f in features[1:]), F.col(features[0])) / len(features)
    return shares.select(F.coalesce(mean, F.lit(0.0)).alias("outlier_rate"))
