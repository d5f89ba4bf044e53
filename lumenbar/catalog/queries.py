"""Every registered query: ``(spark, folder) -> DataFrame`` over whole tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbar.functions.formatting import growth_text
from lumenbar.operators import audit, backtest, drift, guards, incremental, indicators, labels
from lumenbar.operators import digests, histograms, merge, metrics
from lumenbar.operators import quality, quantiles, splits
from lumenbar.operators.nav import nav_features
from lumenbar.functions.scoring import signal_label
from lumenbar.operators.panel import growth_as_of, latest_per
from lumenbar.operators.panel import symbol_history as history_of
from lumenbar.plans import scoring, serving, training, walkforward
from lumenbar.plans.feature_etl import build_features
from lumenbar.schemas import FEATURES, HORIZONS, NAV_FEATURES
from lumenbar.session import new_folder, stored
from lumenbar.sources import payloads, reports
from lumenbar.sources.tables import key_bounds
from lumenbar.sources.versioned import VersionedTable, replaced
from lumenbar.sources.testdata import audit_log, bars, logistic_score, table

AS_OF = "2024-01-31"
BAR_KEYS = ["symbol", "event_time"]
PRICES = ["open", "high", "low", "close", "volume"]


# Values that are only copied, never summed: equal to the last bit, so not rounded.
RAW = {"open", "high", "low", "close", "future_close", "latest_close"}


def present(df: DataFrame) -> DataFrame:
    """Comparable output: 4 decimals, long integers, dates and arrays as text."""
    out = []
    for f in df.schema:
        c, t = F.col(f.name), f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = c if f.name in RAW else F.round(c.cast("double"), 4) + 0.0
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(F.array_sort(c), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- shared inputs ----------------------------------------------------------------


def features(spark: SparkSession, d: str) -> DataFrame:
    return indicators.all_indicators(bars(spark, d))


def silver(spark: SparkSession, d: str) -> DataFrame:
    """The feature table as a job would store it, for queries that read it repeatedly."""
    return stored(features(spark, d))


def labelled(spark: SparkSession, d: str, horizon: str = "1y") -> DataFrame:
    return labels.validation_rows(features(spark, d), HORIZONS[horizon])


def scored(spark: SparkSession, d: str, horizon: str = "1y") -> DataFrame:
    """Labelled rows with the deterministic stand-in probability, stored."""
    rows = labelled(spark, d, horizon).select(
        "symbol",
        "event_date",
        "target",
        "realized_return",
        logistic_score(F.col("rsi_14")).alias("prob"),
    )
    return stored(rows)


def split_scored(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return splits.test_rows(rows, splits.walk_forward_splits(rows))


def signal_history(spark: SparkSession, d: str, table: DataFrame | None = None) -> DataFrame:
    rows = (features(spark, d) if table is None else table).dropna(subset=["rsi_14", "sma_50", "sma_200"])
    return scoring.signals_from_scores(
        rows.fillna(0.0, subset=FEATURES).withColumns(
            {"_p1y": logistic_score(F.col("rsi_14")), "_p5y": logistic_score(F.col("stoch_k"))}
        )
    )


def intraday(spark: SparkSession, d: str) -> DataFrame:
    """Events as a timestamped panel: one series per event type."""
    v = F.sqrt("value")
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("event_time"),
        (v * 1.01).alias("high"),
        (v * 0.99).alias("low"),
        v.alias("close"),
    )


# --- ingest -----------------------------------------------------------------------


def bars_ohlcv(spark, d):
    return bars(spark, d)


def _monthly(df: DataFrame, entry, extra=None) -> DataFrame:
    """One payload per symbol and month (at most 31 bars)."""
    collected = F.array_sort(F.collect_list(entry))
    return df.groupBy("symbol", F.date_trunc("month", "event_time").alias("month")).agg(
        (collected if extra is None else F.concat(collected, F.array(extra))).alias("entries")
    )


def kline_decode(spark, d):
    millis = F.unix_millis(F.col("event_time").cast("timestamp"))
    entry = F.array(millis.cast("string"), *[F.col(c).cast("string") for c in PRICES])
    raw = _monthly(bars(spark, d), entry).select("symbol", F.to_json("entries").alias("payload"))
    out = payloads.decode_klines(raw)
    return out.withColumn("event_time", F.to_date("event_time"))


def nav_decode(spark, d):
    def entry(date, nav):
        return F.struct(date.alias("date"), nav.alias("nav"))

    good = entry(F.date_format("event_time", "dd-MM-yyyy"), F.col("close").cast("string"))
    broken = entry(F.lit("31-02-20xx"), F.lit("n/a"))
    raw = _monthly(bars(spark, d), good, broken).select(
        F.col("symbol").alias("code"),
        F.concat(F.lit("Fund "), "symbol").alias("name"),
        F.to_json(F.struct(F.col("entries").alias("data"))).alias("payload"),
    )
    return payloads.decode_navs(raw)


def catalogue_filter(spark, d):
    house = (
        F.when(F.col("p_type") == "ECONOMY", "HDFC")
        .when(F.col("p_type") == "SMALL", "sbi")
        .when(F.col("p_type") == "STANDARD", "Motilal Oswal")
        .otherwise("Plain House")
    )
    plan = (
        F.when(F.col("p_size") < 15, "Direct Growth")
        .when(F.col("p_size") < 25, "Regular Growth")
        .when(F.col("p_size") < 35, "Direct Growth idcw")
        .otherwise("direct Growth")
    )
    named = table(spark, d, "part").select(
        "p_partkey", F.concat_ws(" ", house, "p_name", plan).alias("schemeName")
    )
    return payloads.select_funds(named)


def constituents(spark, d):
    listed = table(spark, d, "part").select(
        F.upper(F.regexp_replace("p_name", " ", "")).alias("Symbol")
    )
    return payloads.constituents(listed).groupBy("ticker").agg(F.count("*").alias("parts"))


def ohlcv_normalise(spark, d):
    b = bars(spark, d)
    gaps = b.withColumns(
        {
            "open": F.when(F.col("close") >= F.col("open"), F.col("open")),
            "volume": F.when(F.col("volume") > 200, F.col("volume")),
            "asset_name": F.when(F.col("close") > 1000, F.concat(F.lit("Asset "), "symbol")),
        }
    )
    return payloads.normalise_ohlcv(gaps)


def incremental_load(spark, d):
    b = bars(spark, d)
    existing = b.where((F.col("event_time") <= F.lit("1998-01-01").cast("date")) & (F.col("symbol") != "Brand#1"))
    return merge.newer_than_watermark(b, existing, start_date="1997-01-01")


def incremental_load_inclusive(spark, d):
    b = bars(spark, d)
    existing = b.where((F.col("event_time") <= F.lit("1998-01-01").cast("date")) & (F.col("symbol") != "Brand#1"))
    return merge.newer_than_watermark(b, existing, inclusive=True, start_date="1997-01-01")


def incremental_load_ledger(spark, d):
    """Watermarks kept batch by batch (the last one late), never read from the history."""
    b = bars(spark, d)
    t = F.col("event_time")
    existing = b.where((t <= F.lit("1998-01-01").cast("date")) & (F.col("symbol") != "Brand#1"))
    first, late = F.lit("1994-01-01").cast("date"), F.lit("1996-01-01").cast("date")
    ledger = merge.watermarks(existing.where(t < first))
    for batch in (existing.where(t >= late), existing.where((t >= first) & (t < late))):
        ledger = stored(merge.advance_watermarks(ledger, batch))
    return merge.newer_than_marks(b, ledger, start_date="1997-01-01")


def _upsert_pair(spark, d):
    """Stored: orders up to 1998. Incoming: every order no longer open, repriced."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    stored = orders.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    incoming = orders.where(F.col("o_orderstatus") != "O").withColumns(
        {"o_totalprice": F.col("o_totalprice") + 1000, "o_orderpriority": F.lit("0-NEW")}
    )
    return stored.drop("o_orderdate"), incoming.drop("o_orderdate")


def upsert_ignore(spark, d):
    stored, incoming = _upsert_pair(spark, d)
    return merge.insert_only(stored, incoming, ["o_orderkey"])


def upsert_columns(spark, d):
    stored, incoming = _upsert_pair(spark, d)
    return merge.update_columns(stored, incoming, ["o_orderkey"], ["o_totalprice"])


def upsert_replace(spark, d):
    stored, incoming = _upsert_pair(spark, d)
    return merge.replace_rows(stored, incoming, ["o_orderkey"])


def signals_upsert_twice(spark, d):
    """Incoming rows that repeat their keys, merged twice: the dearest of a key stays."""
    stored, incoming = _upsert_pair(spark, d)
    cheaper = incoming.withColumn("o_totalprice", F.col("o_totalprice") - 500)
    repeated = cheaper.unionByName(incoming)
    once = merge.replace_rows(stored, repeated, ["o_orderkey"], newest_by="o_totalprice")
    return merge.replace_rows(once, repeated, ["o_orderkey"], newest_by="o_totalprice")


def schema_evolution(spark, d):
    """Stored rows without a priority column gain it, as NULL, before a replacing merge."""
    stored, incoming = _upsert_pair(spark, d)
    old = merge.evolve(stored.drop("o_orderpriority"), incoming)
    return merge.replace_rows(old, incoming, ["o_orderkey"])


def versioned_merge(spark, d):
    """A stored table gains a column in its second merge and keeps it through a narrower third."""
    stored_rows, incoming = _upsert_pair(spark, d)
    status = "o_orderstatus"
    kept = VersionedTable(spark, new_folder(spark))
    even = F.col("o_orderkey") % 2 == 0
    kept.merge(stored_rows.drop("o_orderpriority"), ["o_orderkey", status], [status])
    kept.merge(incoming.where(even), ["o_orderkey", status])
    kept.merge(incoming.where(~even).drop("o_orderpriority"), ["o_orderkey", status])
    return kept.read()


def _changed_customers(spark, d):
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    customer = table(spark, d, "customer").select(*columns)
    before = customer.where(F.col("c_acctbal") >= 0)
    raised = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 10).otherwise(
        F.col("c_acctbal")
    )
    after = customer.where(F.col("c_mktsegment") != "MACHINERY").withColumn("c_acctbal", raised)
    return before, after


def change_log(spark, d):
    before, after = _changed_customers(spark, d)
    return _balances(merge.change_log(before, after, ["c_custkey"]))


def change_log_digest(spark, d):
    """The same log from the key buckets whose stored digests differ."""
    before, after = _changed_customers(spark, d)
    kept = tuple(stored(digests.bucket_digests(x, ["c_custkey"])) for x in (before, after))
    return _balances(digests.change_log_by_digest(before, after, ["c_custkey"], kept))


def _balances(log):
    def balance(c):
        return F.get_json_object(c, "$.c_acctbal").cast("double")

    return log.select(
        "c_custkey",
        "operation",
        "changed_columns",
        balance("old_values").alias("old_acctbal"),
        balance("new_values").alias("new_acctbal"),
    )


def read_bounds(spark, d):
    return key_bounds(table(spark, d, "orders"), "o_orderkey")


# --- features ---------------------------------------------------------------------


def sma_bollinger_volatility(spark, d):
    columns = ["sma_50", "sma_200", "moving_avg_7d", "volatility_7d", "bb_upper", "bb_lower"]
    return indicators.price_bands(bars(spark, d)).select(*BAR_KEYS, *columns)


def ema_macd(spark, d):
    return indicators.trend_lines(bars(spark, d)).select(
        *BAR_KEYS, "ema_20", "macd", "macd_signal"
    )


def rsi_atr_stochastic(spark, d):
    return indicators.oscillators(bars(spark, d)).select(
        *BAR_KEYS, "rsi_14", "atr_14", "stoch_k", "stoch_d"
    )


def feature_table(spark, d):
    return indicators.warm(features(spark, d)).select(*BAR_KEYS, "close", *FEATURES)


def incremental_features(spark, d):
    """The last 60 days appended in two batches to the state behind the days before."""
    panel = stored(bars(spark, d), "event_time")
    newest = panel.agg(F.max("event_time")).first()[0]
    cut, middle = newest - timedelta(60), newest - timedelta(30)
    day = F.col("event_time")
    state = stored(incremental.append_features(None, panel.where(day <= F.lit(cut))).state)
    first = incremental.append_features(state, panel.where((day > F.lit(cut)) & (day <= F.lit(middle))))
    state = stored(replaced(state, first.state, ["symbol"]))
    second = incremental.append_features(state, panel.where(day > F.lit(middle)))
    return first.features.unionByName(second.features).select(*BAR_KEYS, "close", *FEATURES)


def nav_feature_table(spark, d):
    return nav_features(bars(spark, d)).select(*BAR_KEYS, *NAV_FEATURES)


def warm_rows(spark, d):
    """Feature rows with at least 200 bars behind them."""
    return indicators.warm(indicators.price_bands(bars(spark, d)), 200).select(
        *BAR_KEYS, "sma_50", "sma_200"
    )


def intraday_indicators(spark, d):
    """Timestamped series, cut into segments of about 3,000 rows."""
    return indicators.all_indicators(
        intraday(spark, d), rows_per_segment=INTRADAY_ROWS, bucket="hour"
    ).select(*BAR_KEYS, *FEATURES)


# Longer than the longest frame; the production default is a million rows.
INTRADAY_ROWS = 3000


def intraday_labels(spark, d):
    return labels.forward_close(
        intraday(spark, d), 252, rows_per_segment=INTRADAY_ROWS, bucket="hour"
    ).select(*BAR_KEYS, "close", "future_close")


def latest_features(spark, d):
    return scoring.eligible_latest(features(spark, d)).select(*BAR_KEYS, "close", *FEATURES)


def indicator_self_check(spark, d):
    """The fused plan against the three separate ones, and per indicator the number and
    mean of its values, which SQL computes by itself."""
    b = bars(spark, d)
    fused = indicators.all_indicators(b)
    apart = (
        indicators.price_bands(b)
        .join(indicators.trend_lines(b).select(*BAR_KEYS, "ema_20", "macd", "macd_signal"), BAR_KEYS)
        .join(indicators.oscillators(b).select(*BAR_KEYS, "rsi_14", "atr_14", "stoch_k", "stoch_d"), BAR_KEYS)
    )
    values = quantiles.unpivot_values(fused, FEATURES).groupBy("feature").agg(
        F.count("*").alias("present"), F.avg("value").alias("mean_value")
    )
    checked = indicators.max_differences(fused, apart, FEATURES)
    # a row per indicator on both sides
    return checked.join(F.broadcast(values), F.col("indicator") == F.col("feature")).drop("feature")


# --- labels -----------------------------------------------------------------------


def forward_labels_1y(spark, d):
    return labelled(spark, d, "1y").select(*BAR_KEYS, "future_close", "target", "realized_return")


def forward_labels_5y(spark, d):
    return labelled(spark, d, "5y").select(*BAR_KEYS, "future_close", "target", "realized_return")


def _training(spark, d):
    return labels.training_rows(features(spark, d), HORIZONS["1y"])


def _stored_training(spark, d):
    """The training frame as the training job keeps it."""
    rows = _training(spark, d).select(*BAR_KEYS, "close", "target", *FEATURES)
    return stored(rows, "event_time")


def training_profile(spark, d):
    return labels.training_profile(_training(spark, d))


def winsorize_features(spark, d):
    return quantiles.winsorize(silver(spark, d), FEATURES).select(*BAR_KEYS, *FEATURES)


def outlier_rate(spark, d):
    return quantiles.outlier_rate(silver(spark, d), FEATURES)


def feature_quantiles(spark, d):
    q = quantiles.exact_quantiles(
        quantiles.unpivot_values(silver(spark, d), FEATURES), [0.005, 0.25, 0.5, 0.75, 0.995]
    )
    names = ["q005", "q250", "q500", "q750", "q995"]
    return q.select("feature", "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def recency_cap(spark, d):
    return labels.most_recent(_stored_training(spark, d), 10_000).select(*BAR_KEYS, "target")


def chrono_split(spark, d):
    older, newer = labels.chronological_split(_stored_training(spark, d))
    return older.select(F.lit("train").alias("side"), *BAR_KEYS).unionByName(
        newer.select(F.lit("test").alias("side"), *BAR_KEYS)
    )


# --- signals and serving ----------------------------------------------------------


def signals_scored(spark, d):
    return signal_history(spark, d)


def signals_latest(spark, d):
    """The daily job: score the latest rows, merge them into last year's signals."""
    f = silver(spark, d)
    stored = signal_history(spark, d, f).where(F.col("trade_date") < F.lit("2001-06-30").cast("date"))
    return scoring.generate_signals(
        f,
        scoring.column_scorer(logistic_score(F.col("rsi_14"))),
        scoring.column_scorer(logistic_score(F.col("stoch_k"))),
        existing=stored,
    ).select("symbol", "trade_date", "signal_1y", "signal_5y", "risk_adjusted_score")


def fund_signals(spark, d):
    """Net asset values to fund features to the newest signal of each fund."""
    prices = bars(spark, d).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    table_ = stored(build_features(prices.withColumn("volume", F.lit(0.0)), is_fund=True))
    momentum = 1.0 / (1.0 + F.exp(F.col("nav_momentum_14d") * -10.0))
    return scoring.generate_signals(
        table_,
        scoring.column_scorer(momentum),
        scoring.column_scorer(logistic_score(F.col("stoch_k"))),
        model_features=[*FEATURES, *NAV_FEATURES],
    ).select("symbol", "trade_date", "signal_1y", "signal_5y", "confidence_1y", "risk_adjusted_score")


def fallback_signals(spark, d):
    """Signals of the artifact that a failed gate leaves: probability 0 everywhere."""
    empty = training.Artifact(list(FEATURES), [])
    return scoring.generate_signals(silver(spark, d), empty.score, empty.score).select(
        "symbol", "trade_date", "signal_1y", "signal_5y", "combined_confidence", "risk_adjusted_score"
    )


def ensemble_vote(spark, d):
    """The weighted vote of two given probabilities of every labelled row, and its label."""
    rows = labelled(spark, d)
    parts = [logistic_score(F.col("rsi_14")), logistic_score(F.col("stoch_k"))]
    vote = training.weighted_vote(parts, [0.8, 0.01])
    return rows.select("symbol", "event_date", vote.alias("prob")).withColumn(
        "label", signal_label(F.col("prob"), "1y")
    )


def training_registry(spark, d):
    """Events read as training runs: the newest of each table and horizon."""
    runs = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").alias("updated_at"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source_table"),
        F.when(F.col("value") < 20, "1y").otherwise("5y").alias("horizon"),
        F.col("event_type").alias("status"),
    )
    return training.registry(runs).drop("updated_at")


def boost_stopping(spark, d):
    """Boosting with held rows: how many they are, and that it kept the rounds up to the best."""
    rows = _stored_training(spark, d)
    settings = training.ModelSettings(boost_rounds=40, boost_depth=4, boost_stop_rows=100)
    count = rows.count()
    model = training.fit_model(rows, "histgb", FEATURES, count, "1y", settings)
    held = rows.where(training.held_for_stopping(rows, settings.boost_held_share, settings.seed))
    booster = model.stages[-1]
    losses = booster.evaluateEachIteration(model.stages[0].transform(held))
    best = min(losses) >= losses[-1] - 1e-6 and 0 < len(losses) <= settings.boost_rounds
    return held.agg(F.count("*").alias("held_rows")).select(
        F.lit(count).alias("row_count"), "held_rows", F.lit(best).alias("kept_to_the_best")
    )


def api_signals(spark, d):
    return serving.api_signals(signal_history(spark, d), limit=50, min_confidence=0.7)


def opportunities(spark, d):
    f = silver(spark, d)
    return serving.opportunities(signal_history(spark, d, f), f)


def market_overview(spark, d):
    f = silver(spark, d)
    return serving.market_overview(signal_history(spark, d, f), f)


def symbol_history(spark, d):
    """Every bar of one symbol; the filter is the feature."""
    return history_of(bars(spark, d), "Brand#11")


def growth_asof(spark, d):
    out = growth_as_of(bars(spark, d), (1, 3, 5, 10))
    return out.withColumn("growth_1y_text", growth_text(F.col("growth_1y")))


def technical_context(spark, d):
    return serving.technical_context(features(spark, d))


# --- validation -------------------------------------------------------------------


def walk_forward_splits(spark, d):
    return splits.walk_forward_splits(labelled(spark, d))


def leakage_checks(spark, d):
    rows = scored(spark, d)
    return splits.leakage_checks(rows, splits.walk_forward_splits(rows), target="target")


def key_overlap(spark, d):
    """Keys shared by two overlapping calendar windows."""
    rows = bars(spark, d).withColumnRenamed("event_time", "event_date")
    day = F.col("event_date")
    return splits.key_overlap(
        rows.where(day <= F.lit("1999-12-31").cast("date")),
        rows.where(day >= F.lit("1999-07-01").cast("date")),
    )


def classification_metrics(spark, d):
    return metrics.classification_metrics(split_scored(spark, d), ["split"])


def class_report(spark, d):
    rows = scored(spark, d).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    return metrics.class_report(rows)


def confidence_buckets(spark, d):
    return backtest.confidence_buckets(split_scored(spark, d), ["split"])


def regime_performance(spark, d):
    return backtest.regime_performance(split_scored(spark, d), ["split"])


def backtest_periods(spark, d):
    return backtest.period_returns(scored(spark, d))


def backtest_stats(spark, d):
    return backtest.backtest(split_scored(spark, d), HORIZONS["1y"].bars_ahead, ["split"])


def threshold_sweep(spark, d):
    return backtest.threshold_sweep(split_scored(spark, d), HORIZONS["1y"].bars_ahead)


def threshold_sweep_splits(spark, d):
    return backtest.threshold_sweep_splits(split_scored(spark, d), HORIZONS["1y"].bars_ahead)


def recommended_threshold(spark, d):
    return backtest.recommended_threshold(threshold_sweep(spark, d))


def horizon_summary(spark, d):
    rows = split_scored(spark, d)
    stats = backtest.backtest(rows, HORIZONS["1y"].bars_ahead, ["split"]).drop("threshold")
    return backtest.horizon_summary(
        metrics.classification_metrics(rows, ["split"]).join(stats, "split")
    )


def _drift_windows(spark, d):
    rows = silver(spark, d).withColumnRenamed("event_time", "event_date")
    return drift.drift_windows(rows)


def _drift_counts(windows):
    return stored(drift.value_counts(windows, FEATURES))


def drift_psi(spark, d):
    return drift.psi(_drift_counts(_drift_windows(spark, d)))


def _stored_days(spark, rows):
    """Histograms of all days, stored in two batches, the second with a day of the first again."""
    path = new_folder(spark)
    t = F.col("event_date")
    cut = F.lit("1995-06-15").cast("date")
    histograms.write_days(rows.where(t <= cut), FEATURES, path)
    histograms.write_days(rows.where(t >= cut), FEATURES, path)
    return path


def drift_psi_daily(spark, d):
    """PSI from stored daily histograms; values are read of the bins with an edge only."""
    rows = stored(silver(spark, d).withColumnRenamed("event_time", "event_date"))
    days = histograms.read_days(spark, _stored_days(spark, rows))
    return histograms.histogram_psi(days, drift.drift_windows(rows), FEATURES)


def feature_quantiles_daily(spark, d):
    rows = stored(silver(spark, d).withColumnRenamed("event_time", "event_date"))
    days = histograms.read_days(spark, _stored_days(spark, rows))
    q = histograms.histogram_quantiles(days, rows, FEATURES, [0.005, 0.25, 0.5, 0.75, 0.995])
    names = ["q005", "q250", "q500", "q750", "q995"]
    return q.select("feature", "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def drift_ks(spark, d):
    return drift.ks(_drift_counts(_drift_windows(spark, d)))


def drift_summary(spark, d):
    windows = _drift_windows(spark, d)
    return drift.drift_summary(windows, drift.feature_drift(_drift_counts(windows)))


def _regime_rows(spark, d):
    """Regime rows of every split; thin cells lose their hit rate."""
    rows = regime_performance(spark, d)
    return rows.withColumn("hit_rate", F.when(F.col("samples") >= 20, F.col("hit_rate")))


def regime_rollup_api(spark, d):
    return reports.regime_rollup(_regime_rows(spark, d), [])


def regime_rollup_report(spark, d):
    return reports.regime_rollup(_regime_rows(spark, d), [], missing_as_zero=True)


def _symbol_reports(spark, d):
    """A validation report per symbol, in the nested form of the summary files."""
    rows = scored(spark, d).withColumn("source_table", F.col("symbol"))
    key = ["source_table"]
    measured = metrics.classification_metrics(rows, key)
    stats = backtest.backtest(rows, HORIZONS["1y"].bars_ahead, key).drop("threshold")
    regimes = (
        backtest.regime_performance(rows, key)
        .groupBy(*key)
        .agg(
            # three regimes
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "regime",
                        F.col("samples").cast("double").alias("samples"),
                        "hit_rate",
                        "avg_return",
                        "avg_benchmark_return",
                    )
                )
            ).alias("regime_rows")
        )
    )
    joined = measured.join(stats, key).join(regimes, key, "left")
    status = F.when(F.col("rows") >= MIN_REPORT_ROWS, "ok").otherwise("insufficient_history")
    summary = F.struct(
        F.lit(1.0).alias("splits_ran"),
        F.col("roc_auc").alias("avg_roc_auc"),
        F.col("f1").alias("avg_f1"),
        F.col("brier").alias("avg_brier"),
        F.col("cagr_approx").alias("avg_cagr_approx"),
        F.col("sharpe_annualized").alias("avg_sharpe_annualized"),
        F.col("max_drawdown").alias("avg_max_drawdown"),
        F.col("hit_rate").alias("avg_hit_rate"),
    )
    drifted = F.struct(
        F.lit(None).cast("double").alias("avg_psi"),
        F.lit(None).cast("double").alias("avg_ks"),
        F.floor(F.col("brier") * 40).cast("double").alias("high_drift_features"),
        F.lit(1.0).alias("medium_drift_features"),
        F.lit(None).cast("string").alias("recent_start"),
        F.lit(None).cast("string").alias("recent_end"),
    )
    item = F.struct(
        F.lit("1y").alias("horizon"),
        status.alias("status"),
        F.lit("logistic_rsi").alias("selected_model_type"),
        F.lit(0.55).alias("recommended_min_prob"),
        summary.alias("summary"),
        F.when(F.col("accuracy") > 0.49, "ok").otherwise("insufficient_samples").alias(
            "drift_status"
        ),
        drifted.alias("drift_summary"),
        "regime_rows",
    )
    return joined.select(
        "source_table",
        F.lit("2024-01-25 00:00:00").cast("timestamp").alias("generated_at"),
        F.array(item).alias("horizons"),
    )


MIN_REPORT_ROWS = 1280


def _brands(spark, d):
    """Every brand, and every region: those have no report."""
    brands = table(spark, d, "part").select(F.col("p_brand").alias("source_table")).distinct()
    extra = table(spark, d, "region").select(F.col("r_name").alias("source_table"))
    return brands.unionByName(extra).withColumn(
        "asset_class", F.concat(F.lit("class "), "source_table")
    )


def validation_summary(spark, d):
    filed = stored(_symbol_reports(spark, d))
    rows = reports.with_regimes(reports.report_rows(filed, _brands(spark, d)))
    return rows.select(
        "asset_class", "source_table", "horizon", "status", "selected_model_type",
        "recommended_min_prob", "avg_roc_auc", "avg_f1", "avg_brier", "avg_hit_rate",
        "drift_status", "drift_high_features",
        "bull_samples", "bull_hit_rate", "bear_samples", "bear_avg_return",
        "sideways_samples", "sideways_avg_benchmark_return",
    )


def validation_lines(spark, d):
    rows = reports.report_rows(stored(_symbol_reports(spark, d)), _brands(spark, d))
    return reports.validation_lines(reports.with_regimes(rows, missing_as_zero=True))


# --- guards and audit -------------------------------------------------------------


def promotion_gate(spark, d):
    brands = _brands(spark, d)
    rows = reports.report_rows(stored(_symbol_reports(spark, d)), brands).where(
        F.col("generated_at").isNotNull()
    )
    return guards.promotion_gate(
        rows, brands, AS_OF, "1Y", min_avg_roc_auc=0.45, max_high_drift_features=10
    ).select(
        "source_table", "horizon", "report_age_days", "avg_roc_auc", "avg_f1",
        "high_drift_features", "reason", "gate_status",
    )


def report_completeness(spark, d):
    """Events read as report writes: a table per user, an artifact per event type."""
    kind = F.col("event_type")
    names = {
        "view": "walk_forward_summary.json",
        "click": "walk_forward_splits.csv",
        "signup": "walk_forward_buckets.csv",
        "purchase": "walk_forward_thresholds.csv",
    }
    artifact = F.lit("walk_forward_model_compare.csv")
    for event, name in names.items():
        artifact = F.when(kind == event, name).otherwise(artifact)
    writes = table(spark, d, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source_table"),
        artifact.alias("artifact"),
        F.col("ts").alias("generated_at"),
        (F.col("value") > 5).alias("has_horizons"),
    )
    return guards.report_completeness(
        writes.select("source_table").distinct(), writes, "2024-01-25 00:00:00"
    ).select("source_table", "artifact", "is_missing", "is_stale", "is_invalid")


def report_completeness_summary(spark, d):
    return guards.completeness_summary(report_completeness(spark, d))


def gate_failures(spark, d):
    """Events read as training runs: a table per user, a horizon per event type."""
    kind = F.col("event_type")
    key = F.get_json_object("props", "$.k")
    reason = (
        F.when(kind == "error", F.concat(F.lit("schema_gate_failed_missing_columns=c"), key))
        .when(kind == "signup", F.concat(F.lit("freshness_gate_failed_age_days="), key))
        .when(kind == "purchase", F.lit("insufficient_rows_10_lt_5000"))
    )
    runs = table(spark, d, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source_table"),
        F.when(F.col("value") < 20, "1y").when(F.col("value") < 60, "5y").alias("horizon"),
        F.when(reason.isNull(), "ok").otherwise("Fallback").alias("status"),
        reason.alias("reason"),
        F.col("ts").alias("updated_at"),
    )
    return guards.gate_failures(runs).drop("updated_at")


def freshness_sla(spark, d):
    return guards.freshness(
        table(spark, d, "events"), "2024-02-02 00:00:00", max_age_hours=72, time="ts"
    ).select("row_count", "age_hours", "reason", "status")


def freshness_by_table(spark, d):
    """The SLA on every dated table."""
    out = None
    for name, time in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        row = guards.freshness(
            table(spark, d, name), "2024-02-02 00:00:00", max_age_hours=72, time=time
        ).select(F.lit(name).alias("table_name"), "row_count", "age_hours", "reason", "status")
        out = row if out is None else out.unionByName(row)
    return out


def audit_summary(spark, d):
    return audit.daily_summary(audit_log(spark, d), AS_OF, 30)


def audit_run_summary(spark, d):
    runs = audit.run_summary(audit.daily_summary(audit_log(spark, d), AS_OF, 30), AS_OF, 7)
    return audit.report_status(runs, gate_failures(spark, d))


def _reconciliations(spark, d):
    """Lines against the next table of the chain, per pair of tables."""
    pairs = [("orders", "customer"), ("lineitem", "orders"), ("part", "supplier"), ("orders", "orders")]
    out = None
    for source, target in pairs:
        row = audit.reconcile_counts(
            table(spark, d, source), table(spark, d, target), source, target, AS_OF
        )
        out = row if out is None else out.unionByName(row)
    return out


def daily_audit_report(spark, d):
    profiles = quality.quality_profile(
        table(spark, d, "orders"), "orders", ["o_orderkey"], AS_OF
    ).unionByName(
        quality.quality_profile(table(spark, d, "lineitem"), "lineitem", ["l_orderkey"], AS_OF)
    )
    log = audit_log(spark, d)
    return audit.daily_report(
        log.withColumn("start_time", F.col("start_time") + F.expr("INTERVAL '1' DAY")),
        profiles,
        _reconciliations(spark, d),
        "2024-01-31",
    )


def failed_tasks(spark, d):
    return audit.failed_tasks(audit_log(spark, d), AS_OF, 7).select(
        "audit_id", "job", "start_time", "status", "duration_seconds"
    )


def reconcile_counts(spark, d):
    return _reconciliations(spark, d).drop("source_key_columns")


def reconciliation_view(spark, d):
    view = audit.reconciliation_view(_reconciliations(spark, d), "2024-02-05", 7)
    return audit.task_status(view).select(
        "source_table", "target_table", "row_count_variance_percent",
        "reconciliation_status", "data_integrity_status", "task_status",
    )


def reconcile_keys(spark, d):
    return audit.reconcile_keys(
        table(spark, d, "lineitem"),
        table(spark, d, "orders").where(F.col("o_orderstatus") != "P"),
        ["l_orderkey"],
        ["o_orderkey"],
    )


def reconcile_keys_digest(spark, d):
    source = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    target = table(spark, d, "orders").where(F.col("o_orderstatus") != "P")
    target = target.select(F.col("o_orderkey").alias("k")).distinct()
    return digests.reconcile_by_digest(source, target, ["k"])


def _audit_events(spark, d):
    """Start and end events per task; each event of a user is a state of that user's run."""
    kind, v = F.col("event_type"), F.col("value")
    return table(spark, d, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias(
            "audit_id"
        ),
        F.when(kind == "view", "RUNNING").when(kind == "error", "FAILED").otherwise("SUCCESS").alias(
            "status"
        ),
        F.col("ts").alias("event_time"),
        F.col("ts").alias("end_time"),
        kind.alias("source_table"),
        F.lit("gold").alias("target_table"),
        kind.alias("operation"),
        F.floor(v * 100).alias("rows_source"),
        F.floor(v * 90).alias("rows_target"),
    )


def audit_current_state(spark, d):
    return audit.current_state(_audit_events(spark, d)).select(
        "audit_id", "status", "source_table", "rows_source"
    )


def table_lineage(spark, d):
    return audit.lineage(_audit_events(spark, d)).select(
        "audit_id", "source_table", "target_table", "rows_in", "rows_out", "loss_percent",
        "end_time",
    )


def _customer_values(spark, d):
    """Customers with a missing balance where it is negative."""
    return table(spark, d, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    )


def _profile(spark, d):
    rows = _customer_values(spark, d)
    return quality.quality_profile(
        rows, "customer", ["c_mktsegment", "c_nationkey"], AS_OF, "c_acctbal", rows.columns
    )


def quality_profile(spark, d):
    return _profile(spark, d).drop("column_quality", "issue_details")


def quality_columns(spark, d):
    return quality.column_profile(_profile(spark, d)).select(
        "column_name", "null_count", "null_percent", "unique_count"
    )


def quality_issues(spark, d):
    return _profile(spark, d).select("table_name", F.inline("issue_details"))


def _all_profiles(spark, d):
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "supplier": "s_suppkey"}
    out = _profile(spark, d)
    for name, key in keys.items():
        out = out.unionByName(quality.quality_profile(table(spark, d, name), name, [key], AS_OF))
    return out.drop("column_quality", "issue_details")


def quality_gate(spark, d):
    profiles = _all_profiles(spark, d)
    unprofiled = table(spark, d, "region").select(F.lit("region").alias("table_name")).distinct()
    return quality.quality_gate(
        profiles, profiles.select("table_name").unionByName(unprofiled)
    ).select("table_name", "data_completeness_percent", "data_uniqueness_percent", "gate_status")


def quality_dashboard(spark, d):
    return quality.quality_dashboard(_all_profiles(spark, d), "2024-02-05").select(
        "table_name", "check_date", "total_rows", "quality_score", "quality_status", "issue_count"
    )


# --- machine learning -------------------------------------------------------------

# Model sizes are a documented setting; candidates and split steps are the defaults.
SMALL_MODELS = training.ModelSettings(
    boost_rounds=3, boost_depth=3, trees=5, trees_5y=5, tree_depth=4, linear_iterations=20
)
SMALL_TRAINING = training.TrainingSettings(models=SMALL_MODELS)


def class_weights(spark, d):
    """Balanced weights of the training rows."""
    rows = training.with_class_weights(_stored_training(spark, d))
    return rows.groupBy("target").agg(
        F.count("*").alias("row_count"), F.max("_weight").alias("weight")
    )


def training_gates(spark, d):
    """The reason each profile gate gives for the one-year training rows."""
    profile = training_profile(spark, d).first()
    gates = {
        "rows": training.TrainingSettings(min_rows=10**9),
        "symbols": training.TrainingSettings(min_rows=1, min_symbols=10**6),
        "classes": training.TrainingSettings(min_rows=1, min_symbols=1, max_positive_rate=0.0001),
        "open": training.TrainingSettings(
            min_rows=0, min_symbols=0, min_positive_rate=-1.0, max_positive_rate=2.0
        ),
    }
    rows = [(n, training._gate_profile(profile, s, 252)) for n, s in gates.items()]
    return spark.createDataFrame(rows, "gate string, reason string")


def calibration_split(spark, d):
    """Rows and dates of the older part a model is fitted on and the part it is calibrated on."""
    rows = _stored_training(spark, d)
    total = rows.count()
    settings = training.TrainingSettings(
        calibration_min_total=0, calibration_min_held=0, calibration_min_fit=0
    )
    frames = training.calibration_frames(rows, total, settings)

    def side(name, frame):
        return frame.agg(
            F.lit(name).alias("side"),
            F.count("*").alias("row_count"),
            F.min("event_time").alias("first_date"),
            F.max("event_time").alias("last_date"),
        )

    return side("fit", frames.fit).unionByName(side("calibrate", frames.recent))


def train_candidates(spark, d):
    """Leaderboard of the three candidates on the newest 20 % of the labelled rows: ranks,
    hold-out rows, and whether the metrics are possible ones. Which model is best is not
    determined, so it is no column."""
    rows = _stored_training(spark, d)
    older_rows = int(rows.count() * 0.8)
    is_older = labels.first_rows_filter(rows, older_rows)
    ranking, _, failed = training.rank_candidates(
        rows.where(is_older), older_rows, rows.where(~is_older), FEATURES, "1y", SMALL_TRAINING
    )
    names = ",".join(sorted(r["model_name"] for r in ranking))
    aucs = [r["roc_auc"] for r in ranking]
    known = [a for a in aucs if a is not None]
    ordered = known == sorted(known, reverse=True) and aucs[: len(known)] == known
    return spark.createDataFrame(
        [
            (
                rank,
                r["rows"],
                names,
                len(failed),
                ordered,
                all(0 <= (r[m] or 0.0) <= 1 for m in ("roc_auc", "brier", "f1", "accuracy")),
            )
            for rank, r in enumerate(ranking, start=1)
        ],
        "place int, row_count long, candidates string, failed int, ordered boolean, possible boolean",
    )


def ensemble_scores(spark, d):
    """Latest signals scored by trained ensembles of both horizons: every probability lies
    in [0, 1] and every label follows from its probability."""
    f = silver(spark, d)
    newest = f.agg(F.max("event_time")).first()[0]
    as_of = datetime(newest.year, newest.month, newest.day)
    models = training.train_all_horizons(f, "silver.bars", as_of, SMALL_TRAINING)
    scorers = [lambda df, out, m=models[h]: m.score(df, out) for h in ("1y", "5y")]
    signals = scoring.generate_signals(f, *scorers)

    def fits(horizon):
        p = F.col(f"confidence_{horizon}")
        return p.between(0.0, 1.0) & (F.col(f"signal_{horizon}") == signal_label(p, horizon))

    return signals.select(
        "symbol", "trade_date", fits("1y").alias("fits_1y"), fits("5y").alias("fits_5y")
    )


def walk_forward_ml(spark, d):
    """Every split of every candidate at the default step: dates and sizes of the split,
    leakage checks, scored rows, and whether the metrics equal those of the stored rows."""
    settings = walkforward.ValidationSettings(models=SMALL_MODELS)
    rows = labelled(spark, d).select(
        "symbol", "event_date", "target", "realized_return", *FEATURES
    )
    rows = stored(rows, "event_date")
    checks = walkforward.usable_splits(rows, settings)
    facts = ["train_end", "test_start", "test_end", "train_rows", "test_rows", "train_positives",
             "overlap_rows", "date_violation"]
    empty = "model_type string, split int, " + ", ".join(
        f"{c} {'boolean' if c == 'date_violation' else 'date' if c[-3:] != 'ows' and c[-3:] != 'ves' else 'long'}"
        for c in facts
    ) + ", scored_rows long, metrics_hold boolean"
    if not checks:
        return spark.createDataFrame([], empty)
    found = walkforward.predict_splits(rows, checks, "1y", settings)
    if found is None:
        return spark.createDataFrame([], empty)
    key = ["model_type", "split"]
    measured = metrics.classification_metrics(found, key)
    right = (F.col("prob") >= 0.5) == (F.col("target") == 1)
    again = found.groupBy(*key).agg(
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("a"),
        F.avg(F.pow(F.col("prob") - F.col("target"), F.lit(2.0))).alias("b"),
        F.min("prob").alias("low"),
        F.max("prob").alias("high"),
    )
    close = (F.abs(F.col("a") - F.col("accuracy")) < 1e-9) & (F.abs(F.col("b") - F.col("brier")) < 1e-9)
    # one row per split
    of_split = spark.createDataFrame(checks).select("split", *facts)
    return measured.join(again, key).join(F.broadcast(of_split), "split").select(
        *key,
        *facts,
        F.col("rows").alias("scored_rows"),
        (close & (F.col("low") >= 0) & (F.col("high") <= 1)).alias("metrics_hold"),
    )


QUERIES = {
    q.__name__: q
    for q in [
        bars_ohlcv, kline_decode, nav_decode, catalogue_filter, constituents, ohlcv_normalise,
        incremental_load, incremental_load_inclusive, upsert_ignore, upsert_columns,
        upsert_replace, schema_evolution, change_log, read_bounds,
        sma_bollinger_volatility, ema_macd, rsi_atr_stochastic, feature_table,
        nav_feature_table, warm_rows, intraday_indicators, intraday_labels, latest_features,
        indicator_self_check, forward_labels_1y, forward_labels_5y, training_profile,
        winsorize_features, outlier_rate, feature_quantiles, recency_cap, chrono_split,
        signals_scored, signals_latest, api_signals, opportunities, market_overview,
        growth_asof, technical_context, walk_forward_splits, leakage_checks, key_overlap,
        classification_metrics, class_report, confidence_buckets, regime_performance,
        backtest_periods, backtest_stats, threshold_sweep, threshold_sweep_splits,
        recommended_threshold, symbol_history, signals_upsert_twice, class_weights,
        training_gates, calibration_split,
        horizon_summary, drift_psi, drift_ks, drift_summary, regime_rollup_api,
        regime_rollup_report, validation_summary, validation_lines, promotion_gate,
        report_completeness, report_completeness_summary, gate_failures, freshness_sla,
        freshness_by_table, audit_summary, audit_run_summary, daily_audit_report,
        failed_tasks, reconcile_counts, reconciliation_view, reconcile_keys,
        audit_current_state, table_lineage, quality_profile, quality_columns,
        quality_issues, quality_gate, quality_dashboard, train_candidates, ensemble_scores,
        walk_forward_ml, versioned_merge, incremental_features, fund_signals, fallback_signals,
        ensemble_vote, training_registry, boost_stopping, incremental_load_ledger,
        change_log_digest, reconcile_keys_digest, drift_psi_daily, feature_quantiles_daily,
    ]
}


def registered() -> dict:
    """Queries with comparable output columns."""

    def wrap(query):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return present(query(spark, folder))

        run.__name__ = query.__name__
        run.__doc__ = query.__doc__
        return run

    return {name: wrap(query) for name, query in QUERIES.items()}
