"""Daily value histograms: kept as a table, summed over days, exact where it matters.

A day's counts per (feature, value bin) are computed once, when the day arrives. Quantiles and
PSI over any window sum the bins of its days; only the bins that hold a wanted rank or edge are
looked up in the rows themselves, so results equal those of a pass over all values.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbar.operators.drift import PSI_BINS, psi_cuts, psi_of_bins
from lumenbar.operators.quantiles import exact_quantiles, order_bin, unpivot_values
from lumenbar.session import scratch
from lumenbar.sources.tables import table_exists

#: Bins per e-fold of magnitude: a bin is about 0.4 % wide, some thousand bins a feature.
DAILY_BINS_PER_E = 256

HISTOGRAM_SCHEMA = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("feature", T.StringType()),
        T.StructField("_bin", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("month", T.StringType()),
    ]
)


def daily_histogram(
    df: DataFrame, features: Sequence[str], date: str = "event_date"
) -> DataFrame:
    """Rows and sum of values per day, feature and bin; combines in the map tasks.

    Missing and non-finite values are in no bin; rows without a date are a day of their own.
    """
    long = unpivot_values(
        df.withColumn("day", F.to_date(date)), [f for f in features if f in df.columns], ["day"]
    )
    return long.groupBy("day", "feature", order_bin(F.col("value"), DAILY_BINS_PER_E).alias("_bin")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


def write_days(
    df: DataFrame, features: Sequence[str], path: str, date: str = "event_date"
) -> int:
    """Store the histograms of ``df``'s days, each replacing what was stored of that day.

    ``df`` must hold its days whole. Months are folders; only those touched are rewritten, from
    a staged copy. Running a day again changes nothing. Returns the months written.
    """
    spark = df.sparkSession
    with scratch(spark) as held:
        month = F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none"))
        fresh = held.store(
            daily_histogram(df, features, date).withColumn("month", month).select(*HISTOGRAM_SCHEMA.names)
        )
        # one value per calendar month
        touched = [r[0] for r in fresh.select("month").distinct().collect()]
        if not touched:
            return 0
        if table_exists(spark, path):
            old = read_days(spark, path).where(F.col("month").isin(touched))
            # one row per calendar day
            days = F.broadcast(fresh.select(F.col("day").alias("_day")).distinct())
            kept = old.join(days, F.col("day").eqNullSafe(F.col("_day")), "left_anti")
            fresh = held.store(kept.unionByName(fresh))
        (
            fresh.repartition("month")
            .sortWithinPartitions("month", "day", "feature", "_bin")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month")
            .parquet(path)
        )
    return len(touched)


def read_days(
    spark, path: str, first: Date | None = None, last: Date | None = None
) -> DataFrame:
    """Stored histograms; with bounds only the folders of those months are read."""
    return between(spark.read.schema(HISTOGRAM_SCHEMA).parquet(path), first, last)


def between(days: DataFrame, first: Date | None = None, last: Date | None = None) -> DataFrame:
    """Days of a range; the bounds on ``month`` keep other folders unread."""
    if first is not None:
        days = days.where((F.col("month") >= f"{first:%Y-%m}") & (F.col("day") >= F.lit(first)))
    if last is not None:
        days = days.where((F.col("month") <= f"{last:%Y-%m}") & (F.col("day") <= F.lit(last)))
    return days


def histogram_quantiles(
    days: DataFrame, rows: DataFrame, features: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """Exact interpolated quantiles per feature: ``n`` and ``q``.

    ``days`` are the histograms of exactly the days of ``rows``.
    """
    counts = days.groupBy("feature", "_bin").agg(F.sum("n").alias("_n"))
    return exact_quantiles(
        unpivot_values(rows, features), probs, counts=counts, bins_per_e=DAILY_BINS_PER_E
    )


def histogram_psi(
    days: DataFrame, windows: DataFrame, features: Sequence[str], bins: int = PSI_BINS
) -> DataFrame:
    """PSI per feature from daily bins; ``windows`` as `drift.drift_windows` gives it.

    A bin that holds no edge lies between two edges as a whole; values of the bins with an
    edge (at most ``bins + 1`` a feature) come from ``windows``.
    """
    features = [f for f in features if f in windows.columns]
    bounds = windows.select("baseline_start", "baseline_end", "recent_start", "recent_end").first()
    if bounds is None:
        return windows.sparkSession.createDataFrame([], "feature string, psi double")
    is_base = F.col("day") <= F.lit(bounds["baseline_end"])
    summed = (
        between(days, bounds["baseline_start"], bounds["recent_end"])
        .groupBy("feature", "_bin")
        .agg(
            F.sum(F.when(is_base, F.col("n")).otherwise(0)).alias("base"),
            F.sum(F.when(~is_base, F.col("n")).otherwise(0)).alias("recent"),
            F.sum(F.when(is_base, F.col("total")).otherwise(0.0)).alias("_total"),
        )
    )
    baseline = unpivot_values(windows.where(F.col("side") == "baseline"), features)
    edges = exact_quantiles(
        baseline,
        [i / bins for i in range(bins + 1)],
        counts=summed.where(F.col("base") > 0).select("feature", "_bin", F.col("base").alias("_n")),
        bins_per_e=DAILY_BINS_PER_E,
    )
    means = summed.groupBy("feature").agg(F.try_divide(F.sum("_total"), F.sum("base")).alias("_mean"))
    # a row per feature
    cuts = psi_cuts(edges, means, bins).withColumn(
        "_cut_bins", F.transform("_cuts", lambda c: order_bin(c, DAILY_BINS_PER_E))
    )
    whole = (
        summed.join(F.broadcast(cuts), "feature")
        .where(~F.array_contains("_cut_bins", F.col("_bin")))
        .where((F.col("_bin") > F.col("_cut_bins")[0]) & (F.col("_bin") < F.element_at("_cut_bins", -1)))
        .withColumn("_index", F.size(F.filter("_cut_bins", lambda b: b < F.col("_bin"))))
        .select("feature", "_index", "base", "recent")
    )
    v, top = F.col("value"), F.element_at("_cuts", -1)
    base_side = (F.col("side") == "baseline").cast("long")
    cut = (
        unpivot_values(windows, features, ["side"])
        .withColumn("_bin", order_bin(v, DAILY_BINS_PER_E))
        .join(F.broadcast(cuts), "feature")
        .where(F.array_contains("_cut_bins", F.col("_bin")) & (v >= F.col("_cuts")[0]) & (v <= top))
        .withColumn(
            "_index",
            F.when(v == top, F.size("_cuts") - 1).otherwise(F.size(F.filter("_cuts", lambda e: e <= v))),
        )
        .select("feature", "_index", base_side.alias("base"), (1 - base_side).alias("recent"))
    )
    filled = whole.unionByName(cut).groupBy("feature", "_index").agg(
        F.sum("base").alias("_b"), F.sum("recent").alias("_r")
    )
    return psi_of_bins(filled)
