"""Top-N portfolio backtest, threshold sweep, confidence buckets and market regimes.

The scored frame (one row per symbol and date, with ``prob``, ``target`` and
``realized_return``) shrinks to one row per date first; ordered windows run on that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.functions.nulls import finite_or_null
from lumenbar.schemas import BEAR_RETURN, BUCKET_EDGES, BULL_RETURN, SWEEP_THRESHOLDS

DATE = "event_date"


def top_picks(df: DataFrame, keys: Sequence[str], top_n: int, min_prob: float) -> DataFrame:
    """The N most probable symbols of every date; ties by symbol.

    Each map task keeps N rows per date before the shuffle (window group limit).
    """
    ranked = Window.partitionBy(*keys, DATE).orderBy(F.col("prob").desc(), "symbol")
    return (
        df.where(F.col("prob") >= min_prob)
        .select(*keys, DATE, "symbol", "prob", "realized_return")
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= top_n)
        .drop("_rank")
    )


def period_returns(
    df: DataFrame,
    keys: Sequence[str] = (),
    thresholds: Sequence[float] = (0.55,),
    top_n: int = 10,
    cost_bps: float = 20.0,
) -> DataFrame:
    """Per (keys, threshold, date): strategy return after costs, benchmark return, turnover.

    The picks at a threshold are the date's overall top N cut at that threshold, so
    one ranking serves every threshold and the rows are never multiplied by them.
    """
    keys, thresholds = list(keys), [float(t) for t in thresholds]
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    days = (
        df.groupBy(*keys, DATE)
        .agg(F.coalesce(F.avg("realized_return"), F.lit(0.0)).alias("benchmark_return"))
        .withColumn("threshold", grid)
    )
    picked = (
        top_picks(df, keys, top_n, min(thresholds))
        .withColumn("threshold", grid)
        .where(F.col("prob") >= F.col("threshold"))
        .groupBy(*keys, "threshold", DATE)
        .agg(
            F.avg("realized_return").alias("_gross"),
            # at most top_n symbols
            F.collect_set("symbol").alias("_picks"),
        )
    )
    along = Window.partitionBy(*keys, "threshold").orderBy(DATE)
    held = days.join(picked, [*keys, "threshold", DATE], "left").withColumn(
        "_picks",
        F.when(F.col("_gross").isNotNull(), F.col("_picks")).otherwise(
            F.array().cast("array<string>")
        ),
    )
    now, before = F.col("_picks"), F.col("_before")
    moved = F.size(F.array_except(now, before)) + F.size(F.array_except(before, now))
    turnover = (
        F.when(F.col("_gross").isNull(), 0.0)
        .when(before.isNull() | (F.size(before) == 0), 1.0)
        .otherwise(moved / F.lit(2 * max(top_n, 1)))
    )
    return (
        held.withColumn("_before", F.lag("_picks").over(along))
        .withColumn("turnover", turnover)
        .select(
            *keys,
            "threshold",
            DATE,
            F.size("_picks").alias("picks"),
            "benchmark_return",
            "turnover",
            F.coalesce(
                F.col("_gross") - F.lit(cost_bps / 10000.0) * F.col("turnover"), F.lit(0.0)
            ).alias("period_return"),
        )
    )


def backtest_stats(
    periods: DataFrame, holding_days: int, keys: Sequence[str] = ("threshold",)
) -> DataFrame:
    """Return, risk and turnover statistics per key over its dates."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    along = whole.orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r, b = F.col("period_return"), F.col("benchmark_return")
    curve = (
        periods.withColumns(
            {
                "_equity": F.product(r + 1).over(along),
                "_bench_equity": F.product(b + 1).over(along),
                "var_95": F.percentile(r, F.lit(0.05)).over(whole),
            }
        )
        .withColumns(
            {
                "_peak": F.max("_equity").over(along),
                "_bench_peak": F.max("_bench_equity").over(along),
            }
        )
    )
    per_year = 252.0 / max(holding_days, 1)
    years = F.count("*") / F.lit(per_year)

    def annual_growth(equity: str) -> Column:
        return finite_or_null(F.pow(F.max_by(equity, DATE), 1 / years) - 1)

    def ratio(series: Column) -> Column:
        spread = F.stddev_samp(series)
        return F.when(spread > 0, F.try_divide(F.avg(series), spread) * per_year**0.5)

    stats = curve.groupBy(*keys).agg(
        F.count("*").alias("periods"),
        F.avg(r).alias("avg_period_return"),
        F.avg(b).alias("benchmark_avg_period_return"),
        annual_growth("_equity").alias("cagr_approx"),
        annual_growth("_bench_equity").alias("benchmark_cagr_approx"),
        ratio(r).alias("sharpe_annualized"),
        ratio(b).alias("benchmark_sharpe_annualized"),
        ratio(r - b).alias("info_ratio"),
        F.min(F.try_divide(F.col("_equity"), F.col("_peak")) - 1).alias("max_drawdown"),
        F.min(F.try_divide(F.col("_bench_equity"), F.col("_bench_peak")) - 1).alias(
            "benchmark_max_drawdown"
        ),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.avg("turnover").alias("avg_turnover"),
        F.first("var_95").alias("var_95"),
        F.coalesce(F.avg(F.when(r <= F.col("var_95"), r)), F.first("var_95")).alias("cvar_95"),
    )
    return stats.withColumns(
        {
            "holding_period_days": F.lit(int(holding_days)),
            "alpha_avg_period_return": F.col("avg_period_return")
            - F.col("benchmark_avg_period_return"),
            "alpha_cagr": F.col("cagr_approx") - F.col("benchmark_cagr_approx"),
        }
    )


def backtest(
    df: DataFrame,
    holding_days: int,
    keys: Sequence[str] = (),
    top_n: int = 10,
    min_prob: float = 0.55,
    cost_bps: float = 20.0,
) -> DataFrame:
    periods = period_returns(df, keys, [min_prob], top_n, cost_bps)
    return backtest_stats(periods, holding_days, [*keys, "threshold"])


# output name -> split statistic averaged over splits
SWEEP_MEANS = {
    "avg_periods": "periods",
    "avg_period_return": "avg_period_return",
    "avg_benchmark_period_return": "benchmark_avg_period_return",
    "avg_alpha_period_return": "alpha_avg_period_return",
    "avg_cagr_approx": "cagr_approx",
    "avg_benchmark_cagr_approx": "benchmark_cagr_approx",
    "avg_alpha_cagr": "alpha_cagr",
    "avg_sharpe_annualized": "sharpe_annualized",
    "avg_benchmark_sharpe_annualized": "benchmark_sharpe_annualized",
    "avg_information_ratio": "info_ratio",
    "avg_max_drawdown": "max_drawdown",
    "avg_benchmark_max_drawdown": "benchmark_max_drawdown",
    "avg_hit_rate": "hit_rate",
    "avg_turnover": "avg_turnover",
    "avg_var_95": "var_95",
    "avg_cvar_95": "cvar_95",
}


def threshold_sweep(
    df: DataFrame,
    holding_days: int,
    keys: Sequence[str] = (),
    thresholds: Sequence[float] = SWEEP_THRESHOLDS,
    top_n: int = 10,
    cost_bps: float = 20.0,
) -> DataFrame:
    """Mean backtest statistics over splits per (keys, threshold); needs a ``split`` column."""
    return sweep_means(
        threshold_sweep_splits(df, holding_days, keys, thresholds, top_n, cost_bps), keys
    )


def threshold_sweep_splits(
    df: DataFrame,
    holding_days: int,
    keys: Sequence[str] = (),
    thresholds: Sequence[float] = SWEEP_THRESHOLDS,
    top_n: int = 10,
    cost_bps: float = 20.0,
) -> DataFrame:
    """Backtest statistics per (keys, split, threshold)."""
    periods = period_returns(df, [*keys, "split"], thresholds, top_n, cost_bps)
    return backtest_stats(periods, holding_days, [*keys, "split", "threshold"])


def sweep_means(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The split statistics of a sweep averaged over splits."""
    return stats.groupBy(*keys, "threshold").agg(
        F.count_distinct("split").alias("splits"),
        *[F.avg(source).alias(out) for out, source in SWEEP_MEANS.items()],
    )


def recommended_threshold(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best row of a sweep: Sharpe, CAGR, hit rate (missing last), then the lowest threshold."""
    best = Window.partitionBy(*keys).orderBy(
        F.col("avg_sharpe_annualized").desc_nulls_last(),
        F.col("avg_cagr_approx").desc_nulls_last(),
        F.col("avg_hit_rate").desc_nulls_last(),
        "threshold",
    )
    ranked = sweep.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return ranked.select(*keys, F.col("threshold").alias("recommended_min_prob"))


def bucket_label(low: float, high: float) -> str:
    return f"{low:.2f}-{high:.2f}"


def confidence_buckets(
    df: DataFrame, keys: Sequence[str] = (), close_last: bool = False
) -> DataFrame:
    """Samples, hit rate and mean return per probability bucket, empty buckets included.

    Buckets are left-closed; a probability of exactly 1 is in none unless ``close_last``.
    One conditional aggregate, turned into rows afterwards.
    """
    keys = list(keys)
    p = F.col("prob")
    aggs, rows = [], []
    edges = list(zip(BUCKET_EDGES[:-1], BUCKET_EDGES[1:]))
    for i, (low, high) in enumerate(edges):
        inside = (p >= low) & (p < high)
        if close_last and i == len(edges) - 1:
            inside = (p >= low) & (p <= high)
        aggs += [
            F.count(F.when(inside, F.col("target"))).alias(f"_s{i}"),
            F.avg(F.when(inside, F.col("target").cast("double"))).alias(f"_h{i}"),
            F.avg(F.when(inside, F.col("realized_return"))).alias(f"_r{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(bucket_label(low, high)).alias("bucket"),
                F.col(f"_s{i}").alias("samples"),
                F.col(f"_h{i}").alias("hit_rate"),
                F.col(f"_r{i}").alias("avg_realized_return"),
            )
        )
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*rows)))


def regime_of(benchmark: Column) -> Column:
    return (
        F.when(benchmark >= BULL_RETURN, "bull")
        .when(benchmark <= BEAR_RETURN, "bear")
        .otherwise("sideways")
    )


def regime_performance(
    df: DataFrame, keys: Sequence[str] = (), top_n: int = 10, min_prob: float = 0.55
) -> DataFrame:
    """Strategy results per market regime; dates without picks are skipped."""
    keys = list(keys)
    days = df.groupBy(*keys, DATE).agg(F.avg("realized_return").alias("benchmark_return"))
    picks = (
        top_picks(df, keys, top_n, min_prob)
        .groupBy(*keys, DATE)
        .agg(F.avg("realized_return").alias("strategy_return"))
    )
    return (
        days.join(picks, [*keys, DATE])
        .withColumn("regime", regime_of(F.col("benchmark_return")))
        .groupBy(*keys, "regime")
        .agg(
            F.count("strategy_return").alias("samples"),
            F.avg("strategy_return").alias("avg_return"),
            F.avg(F.coalesce((F.col("strategy_return") > 0).cast("double"), F.lit(0.0))).alias(
                "hit_rate"
            ),
            F.avg("benchmark_return").alias("avg_benchmark_return"),
        )
    )


def horizon_summary(split_stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means of split metrics and backtest statistics over the splits that ran."""
    measures = {
        "avg_accuracy": "accuracy",
        "avg_f1": "f1",
        "avg_brier": "brier",
        "avg_roc_auc": "roc_auc",
        **{k: v for k, v in SWEEP_MEANS.items() if "period" not in k},
    }
    return split_stats.groupBy(*keys).agg(
        F.count("*").alias("splits_ran"),
        *[F.avg(finite_or_null(F.col(v))).alias(k) for k, v in measures.items()],
    )
