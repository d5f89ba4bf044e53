"""Feature drift between a baseline and a recent calendar window: PSI and KS."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.operators.quantiles import exact_quantiles, order_bin, unpivot_values

PSI_BINS = 10


def drift_windows(
    df: DataFrame, recent_days: int = 63, baseline_days: int = 252, date: str = "event_date"
) -> DataFrame:
    """Rows of both windows with ``side`` and the window bounds attached.

    The newest date is fetched first, so the bounds are literals that reach the scan.
    """
    newest = df.agg(F.to_date(F.max(date))).first()[0]
    bounds = dict.fromkeys(("recent_end", "recent_start", "baseline_end", "baseline_start"))
    if newest is not None:
        start = newest - timedelta(days=max(recent_days - 1, 1))
        end = start - timedelta(days=1)
        bounds["recent_end"], bounds["recent_start"] = newest, start
        bounds["baseline_end"] = end
        bounds["baseline_start"] = end - timedelta(days=max(baseline_days - 1, 1))
    at = {name: F.lit(value).cast("date") for name, value in bounds.items()}
    side = F.when(F.col(date) >= at["recent_start"], "recent").otherwise("baseline")
    # the windows meet, so one range holds both
    return df.where(F.col(date) >= at["baseline_start"]).withColumns({**at, "side": side})


def value_counts(windows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct values per feature with their baseline and recent counts."""
    long = unpivot_values(windows, [f for f in features if f in windows.columns], ["side"])
    is_base = (F.col("side") == "baseline").cast("long")
    return (
        long.groupBy("feature", "value")
        .agg(F.sum(is_base).alias("base"), F.sum(1 - is_base).alias("recent"))
        .withColumn("_bin", order_bin(F.col("value")))
    )


def psi(counts: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per feature over baseline quantile bins."""
    base = counts.where(F.col("base") > 0)
    edges = exact_quantiles(
        base.select("feature", "value", "base"), [i / bins for i in range(bins + 1)], weight="base"
    )
    means = counts.groupBy("feature").agg(
        F.try_divide(F.sum(F.col("value") * F.col("base")), F.sum("base")).alias("_mean")
    )
    # a row per feature
    cuts = psi_cuts(edges, means, bins)
    v, top = F.col("value"), F.element_at("_cuts", -1)
    index = F.when(v == top, F.size("_cuts") - 1).otherwise(
        F.size(F.filter("_cuts", lambda e: e <= v))
    )
    filled = (
        counts.join(F.broadcast(cuts), "feature")
        .where((v >= F.col("_cuts")[0]) & (v <= top))
        .groupBy("feature", index.alias("_index"))
        .agg(F.sum("base").alias("_b"), F.sum("recent").alias("_r"))
    )
    return psi_of_bins(filled)


def psi_cuts(edges: DataFrame, means: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Edges per feature: its distinct quantiles, or ends and mean where those are too few."""
    ends = F.array(F.col("q")[0], F.col("_mean"), F.col("q")[bins])
    unique = F.array_distinct("q")
    return edges.join(means, "feature").select(
        "feature", F.when(F.size(unique) < 3, ends).otherwise(unique).alias("_cuts")
    )


def psi_of_bins(filled: DataFrame) -> DataFrame:
    """PSI per feature from the baseline and recent counts ``_b``, ``_r`` of its bins."""
    all_bins = Window.partitionBy("feature")

    def share(c: str):
        whole = F.greatest(F.sum(c).over(all_bins), F.lit(1))
        return F.least(F.greatest(F.col(c) / whole, F.lit(1e-6)), F.lit(1.0))

    # a bin empty on both sides contributes nothing
    shares = filled.withColumns({"_e": share("_b"), "_a": share("_r")})
    term = (F.col("_a") - F.col("_e")) * F.ln(F.col("_a") / F.col("_e"))
    return shares.groupBy("feature").agg(F.sum(term).alias("psi"))


def ks(counts: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature, with row counts and means.

    The cumulative gap is built inside value bins and shifted by the gap of all lower
    bins, so no window spans a feature's values.
    """
    totals = counts.groupBy("feature").agg(
        F.sum("base").alias("baseline_n"),
        F.sum("recent").alias("recent_n"),
        F.try_divide(F.sum(F.col("value") * F.col("base")), F.sum("base")).alias("baseline_mean"),
        F.try_divide(F.sum(F.col("value") * F.col("recent")), F.sum("recent")).alias("recent_mean"),
    )
    in_bin = Window.partitionBy("feature", "_bin").orderBy("value")

    def gap(base, recent):
        return F.try_divide(base, F.col("baseline_n")) - F.try_divide(recent, F.col("recent_n"))

    names = ["feature", "baseline_n", "recent_n", "baseline_mean", "recent_mean"]
    bins = (
        counts.withColumns(
            {"_b": F.sum("base").over(in_bin), "_r": F.sum("recent").over(in_bin)}
        )
        .join(F.broadcast(totals), "feature")
        .groupBy(*names, "_bin")
        .agg(
            F.max(gap(F.col("_b"), F.col("_r"))).alias("_high"),
            F.min(gap(F.col("_b"), F.col("_r"))).alias("_low"),
            F.sum("base").alias("_b"),
            F.sum("recent").alias("_r"),
        )
    )
    along = Window.partitionBy("feature").orderBy("_bin")
    shift = gap(
        F.sum("_b").over(along) - F.col("_b"), F.sum("_r").over(along) - F.col("_r")
    )
    return (
        bins.withColumn("_shift", shift)
        .groupBy(*names)
        .agg(
            F.max(
                F.greatest(
                    F.abs(F.col("_shift") + F.col("_high")), F.abs(F.col("_shift") + F.col("_low"))
                )
            ).alias("ks")
        )
    )


def feature_drift(counts: DataFrame, min_samples: int = 300) -> DataFrame:
    """PSI, KS, level and window means of every feature.

    Features with too few values on a side have the level ``insufficient_samples``.
    """
    joined = ks(counts).join(psi(counts), "feature", "left")
    enough = (F.col("baseline_n") >= min_samples) & (F.col("recent_n") >= min_samples)
    level = (
        F.when(~enough, "insufficient_samples")
        .when(F.col("psi").isNull() | F.col("ks").isNull(), "unknown")
        .when((F.col("psi") >= 0.25) | (F.col("ks") >= 0.20), "high")
        .when((F.col("psi") >= 0.10) | (F.col("ks") >= 0.10), "medium")
        .otherwise("low")
    )
    return joined.select(
        "feature", "psi", "ks", level.alias("drift_level"), "baseline_mean", "recent_mean"
    )


def drift_summary(windows: DataFrame, drift: DataFrame, min_samples: int = 300) -> DataFrame:
    """One row: status, window bounds and sizes, mean PSI / KS, features per level."""
    sizes = windows.agg(
        F.max("baseline_start").cast("string").alias("baseline_start"),
        F.max("baseline_end").cast("string").alias("baseline_end"),
        F.max("recent_start").cast("string").alias("recent_start"),
        F.max("recent_end").cast("string").alias("recent_end"),
        F.count_if(F.col("side") == "baseline").alias("baseline_rows"),
        F.count_if(F.col("side") == "recent").alias("recent_rows"),
    )
    levels = drift.where("drift_level <> 'insufficient_samples'").agg(
        F.count("*").alias("features"),
        F.avg("psi").alias("avg_psi"),
        F.avg("ks").alias("avg_ks"),
        F.count_if(F.col("drift_level") == "high").alias("high_drift_features"),
        F.count_if(F.col("drift_level") == "medium").alias("medium_drift_features"),
    )
    short = (F.col("baseline_rows") < min_samples) | (F.col("recent_rows") < min_samples)
    status = (
        F.when(F.col("recent_end").isNull(), "no_data")
        .when(short, "insufficient_samples")
        .when(F.col("features") == 0, "no_valid_features")
        .otherwise("ok")
    )
    # both sides are one row
    return sizes.crossJoin(F.broadcast(levels)).withColumn("status", status)
