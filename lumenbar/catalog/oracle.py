"""SQL counterpart of every registered query, for DuckDB over the same tables.

Written from the operator definitions (recursive EMA, plain windows, `quantile_cont`,
loops over splits as joins), not from the DataFrame plans.
"""

from __future__ import annotations

from lumenbar.schemas import (
    BUCKET_EDGES,
    FEATURES,
    FUND_EXCLUDED,
    FUND_HOUSES,
    FUND_REQUIRED,
    LABEL_RANK,
    LABEL_TEXT,
    NAV_FEATURES,
    PHI_Z_95,
    SIGNAL_THRESHOLDS,
    SWEEP_THRESHOLDS,
    Z_95,
)

AS_OF = "2024-01-31"
ORACLE: dict[str, str] = {}


# Values that are only copied, never summed: equal to the last bit, so not rounded.
RAW = {"open", "high", "low", "close", "future_close", "latest_close"}


def r(x: str, name: str | None = None) -> str:
    """Four decimals without negative zero; copied values as they are."""
    if x in RAW:
        return f"{x} AS {name or x}"
    return f"round(CAST({x} AS DOUBLE), 4) + 0.0 AS {name or x}"


def day(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS VARCHAR) AS {name or x}"


def big(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS BIGINT) AS {name or x}"


def sql(select: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}" if ctes else select


def frame(n: int, order: str = "symbol ORDER BY event_time") -> str:
    return f"OVER (PARTITION BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "OVER (PARTITION BY symbol ORDER BY event_time)"

BARS = """bars AS MATERIALIZED (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS event_time,
         arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px,
               row(l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k
        FROM lineitem JOIN part ON p_partkey = l_partkey)
  GROUP BY 1, 2)"""

EVENT_BARS = """bars AS MATERIALIZED (
  SELECT event_type AS symbol, ts AS event_time, sqrt(value) * 1.01 AS high,
         sqrt(value) * 0.99 AS low, sqrt(value) AS close FROM events)"""

BANDS = f"""bands AS (
  SELECT *, mid + 2 * sd AS bb_upper, mid - 2 * sd AS bb_lower FROM (
    SELECT symbol, event_time, avg(close) {frame(50)} AS sma_50,
           avg(close) {frame(200)} AS sma_200, avg(close) {frame(7)} AS moving_avg_7d,
           stddev_samp(close) {frame(7)} AS volatility_7d,
           avg(close) {frame(20)} AS mid, stddev_samp(close) {frame(20)} AS sd
    FROM bars))"""

TREND = """numbered AS MATERIALIZED (
  SELECT symbol, event_time, close,
         row_number() OVER (PARTITION BY symbol ORDER BY event_time) AS rn FROM bars),
steps AS (
  SELECT symbol, rn, close AS e12, close AS e20, close AS e26, 0.0::DOUBLE AS sig
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, e12, e20, e26, sig + 0.2 * ((e12 - e26) - sig) FROM (
    SELECT n.symbol, n.rn, s.e12 + 2.0 / 13 * (n.close - s.e12) AS e12,
           s.e20 + 2.0 / 21 * (n.close - s.e20) AS e20,
           s.e26 + 2.0 / 27 * (n.close - s.e26) AS e26, s.sig
    FROM steps s JOIN numbered n ON n.symbol = s.symbol AND n.rn = s.rn + 1)),
trend AS (
  SELECT n.symbol, n.event_time, e20 AS ema_20, e12 - e26 AS macd, sig AS macd_signal
  FROM steps s JOIN numbered n ON n.symbol = s.symbol AND n.rn = s.rn)"""

OSC = f"""osc0 AS (
  SELECT symbol, event_time, close, high, low, lag(close) {W} AS prev,
         min(low) {frame(14)} AS lo14, max(high) {frame(14)} AS hi14 FROM bars),
osc1 AS (
  SELECT *, CASE WHEN close - prev > 0 THEN close - prev ELSE 0 END AS up,
         CASE WHEN close - prev < 0 THEN prev - close ELSE 0 END AS down,
         greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
         CASE WHEN hi14 - lo14 <> 0 THEN (close - lo14) / (hi14 - lo14) * 100 ELSE 50 END AS stoch_k
  FROM osc0),
osc2 AS (
  SELECT *, avg(up) {frame(14)} AS mu, avg(down) {frame(14)} AS md,
         avg(tr) {frame(14)} AS atr_14, avg(stoch_k) {frame(3)} AS stoch_d FROM osc1),
osc AS (
  SELECT symbol, event_time, atr_14, stoch_k, stoch_d,
         CASE WHEN mu = 0 AND md = 0 THEN 50 WHEN md = 0 THEN 100
              ELSE 100 - 100 / (1 + mu / md) END AS rsi_14
  FROM osc2)"""

FEATS = """feats AS MATERIALIZED (
  SELECT b.*, sma_50, sma_200, moving_avg_7d, volatility_7d, bb_upper, bb_lower,
         ema_20, macd, macd_signal, rsi_14, atr_14, stoch_k, stoch_d
  FROM bars b JOIN bands USING (symbol, event_time) JOIN trend USING (symbol, event_time)
       JOIN osc USING (symbol, event_time))"""

FEATURE_CTES = [BARS, BANDS, TREND, OSC, FEATS]


def labelled_ctes(bars_ahead: int, gain: float) -> list[str]:
    present = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
    return [
        *FEATURE_CTES,
        f"""trained AS MATERIALIZED (
  SELECT *, CAST(future_close > close * {gain} AS INT) AS target FROM (
    SELECT *, lead(close, {bars_ahead}) {W} AS future_close FROM feats)
  WHERE future_close IS NOT NULL AND {present})""",
        """labelled AS MATERIALIZED (
  SELECT *, event_time AS event_date, future_close / close - 1 AS realized_return,
         1 / (1 + exp(-(rsi_14 - 50) / 10)) AS prob
  FROM trained WHERE close > 0 AND future_close > 0)""",
    ]


LAB1 = labelled_ctes(252, 1.10)
LAB5 = labelled_ctes(1260, 1.50)

SPLITS = """cal AS (
  SELECT event_date, row_number() OVER (ORDER BY event_date) - 1 AS i
  FROM (SELECT DISTINCT event_date FROM labelled)),
splits AS MATERIALIZED (
  SELECT CAST((a.i + 1 - 504) // 63 + 1 AS INT) AS split, a.event_date AS train_end,
         b.event_date AS test_start, c.event_date AS test_end
  FROM cal a JOIN cal b ON b.i = a.i + 1 JOIN cal c ON c.i = a.i + 126
  WHERE a.i + 1 >= 504 AND (a.i + 1 - 504) % 63 = 0)"""

TESTS = """tests AS MATERIALIZED (
  SELECT split, symbol, event_date, target, realized_return, prob
  FROM labelled JOIN splits ON event_date BETWEEN test_start AND test_end)"""

SPLIT_CTES = [*LAB1, SPLITS, TESTS]


def periods_ctes(rows: str, keys: list[str], thresholds: list[float], top_n: int = 10) -> list[str]:
    """Per key, threshold and date: benchmark, turnover and strategy return."""
    k = "".join(f"{c}, " for c in keys)
    on = "".join(f"d.{c} = p.{c} AND " for c in keys)
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return [
        f"grid(threshold) AS (VALUES {values})",
        f"""ranked AS (
  SELECT {k}threshold, event_date, symbol, realized_return,
         row_number() OVER (PARTITION BY {k}threshold, event_date ORDER BY prob DESC, symbol) AS rk
  FROM {rows}, grid WHERE prob >= threshold)""",
        f"""picked AS (
  SELECT {k}threshold, event_date, avg(realized_return) AS gross, list(symbol) AS names
  FROM ranked WHERE rk <= {top_n} GROUP BY ALL)""",
        f"""days AS (
  SELECT {k}threshold, event_date, avg(realized_return) AS bench
  FROM {rows}, grid GROUP BY ALL)""",
        f"""held AS (
  SELECT {''.join(f'd.{c}, ' for c in keys)}d.threshold, d.event_date, bench, gross,
         coalesce(names, []) AS names
  FROM days d LEFT JOIN picked p
    ON {on}d.threshold = p.threshold AND d.event_date = p.event_date)""",
        f"""moved AS (
  SELECT *, lag(names) OVER (PARTITION BY {k}threshold ORDER BY event_date) AS before FROM held)""",
        f"""turned AS (
  SELECT *, CASE WHEN gross IS NULL THEN 0.0 WHEN before IS NULL OR len(before) = 0 THEN 1.0
                 ELSE (len(list_filter(names, lambda x: NOT list_contains(before, x)))
                     + len(list_filter(before, lambda x: NOT list_contains(names, x)))) / {2.0 * top_n} END AS turnover
  FROM moved)""",
        """periods AS MATERIALIZED (
  SELECT *, coalesce(gross - 0.002 * turnover, 0.0) AS ret FROM turned)""",
    ]


def stats_cte(keys: list[str], holding: int, name: str = "stats") -> str:
    k = ", ".join(keys)
    w = f"PARTITION BY {k} ORDER BY event_date ROWS UNBOUNDED PRECEDING"
    per_year = 252.0 / holding

    def growth(eq: str) -> str:
        # a negative end value has no real root
        end = f"arg_max({eq}, event_date)"
        return f"CASE WHEN {end} >= 0 THEN pow({end}, {per_year} / count(*)) - 1 END"

    def ratio(x: str) -> str:
        return (
            f"CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) * sqrt({per_year}) END"
        )

    return f"""curve AS (
  SELECT *, max(eq) OVER ({w}) AS pk, max(beq) OVER ({w}) AS bpk FROM (
    SELECT *, product(1 + ret) OVER ({w}) AS eq, product(1 + bench) OVER ({w}) AS beq,
           quantile_cont(ret, 0.05) OVER (PARTITION BY {k}) AS v95 FROM periods)),
{name} AS MATERIALIZED (
  SELECT {k}, count(*) AS periods, avg(ret) AS avg_period_return,
         avg(bench) AS benchmark_avg_period_return,
         avg(ret) - avg(bench) AS alpha_avg_period_return,
         {growth('eq')} AS cagr_approx, {growth('beq')} AS benchmark_cagr_approx,
         ({growth('eq')}) - ({growth('beq')}) AS alpha_cagr,
         {ratio('ret')} AS sharpe_annualized, {ratio('bench')} AS benchmark_sharpe_annualized,
         {ratio('ret - bench')} AS info_ratio,
         min(eq / pk - 1) AS max_drawdown, min(beq / bpk - 1) AS benchmark_max_drawdown,
         avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(turnover) AS avg_turnover,
         any_value(v95) AS var_95, avg(CASE WHEN ret <= v95 THEN ret END) AS cvar_95,
         {holding} AS holding_period_days
  FROM curve GROUP BY {k})"""


STAT_COLUMNS = [
    "avg_period_return", "benchmark_avg_period_return", "alpha_avg_period_return",
    "cagr_approx", "benchmark_cagr_approx", "alpha_cagr", "sharpe_annualized",
    "benchmark_sharpe_annualized", "info_ratio", "max_drawdown", "benchmark_max_drawdown",
    "hit_rate", "avg_turnover", "var_95", "cvar_95",
]


def metrics_ctes(rows: str, keys: list[str], name: str = "metrics") -> list[str]:
    k = ", ".join(keys)
    part = f"PARTITION BY {k} " if keys else ""
    group = f"GROUP BY {k}" if keys else ""
    lead = f"{k}, " if keys else ""
    return [
        f"""auc_ranks AS (
  SELECT {lead}target, rank() OVER ({part}ORDER BY prob)
         + (count(*) OVER ({part or 'PARTITION BY '}{', ' if keys else ''}prob) - 1) / 2.0 AS rk
  FROM {rows})""",
        f"""aucs AS (
  SELECT {lead}CASE WHEN sum(target) > 0 AND sum(1 - target) > 0 THEN
         (sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0)
         / (CAST(sum(target) AS DOUBLE) * sum(1 - target)) END AS roc_auc
  FROM auc_ranks {group})""",
        f"""{name} AS MATERIALIZED (
  SELECT *, coalesce(2.0 * tp / nullif(called + actual, 0), 0) AS f1,
         coalesce(tp * 1.0 / nullif(called, 0), 0) AS "precision",
         coalesce(tp * 1.0 / nullif(actual, 0), 0) AS recall
  FROM (SELECT {lead}count(*) AS "rows",
               avg(CASE WHEN CAST(prob >= 0.5 AS INT) = target THEN 1.0 ELSE 0.0 END) AS accuracy,
               sum(CASE WHEN prob >= 0.5 AND target = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) AS called, sum(target) AS actual,
               avg((prob - target) * (prob - target)) AS brier
        FROM {rows} {group}) {f'JOIN aucs USING ({k})' if keys else ', aucs'})""",
    ]


def regimes_ctes(rows: str, keys: list[str], name: str = "regimes") -> list[str]:
    k = "".join(f"{c}, " for c in keys)
    return [
        f"""rday AS (SELECT {k}event_date, avg(realized_return) AS bench FROM {rows} GROUP BY ALL)""",
        f"""rpick AS (
  SELECT {k}event_date, avg(realized_return) AS strat FROM (
    SELECT {k}event_date, realized_return,
           row_number() OVER (PARTITION BY {k}event_date ORDER BY prob DESC, symbol) AS rk
    FROM {rows} WHERE prob >= 0.55) WHERE rk <= 10 GROUP BY ALL)""",
        f"""{name} AS MATERIALIZED (
  SELECT {k}CASE WHEN bench >= 0.002 THEN 'bull' WHEN bench <= -0.002 THEN 'bear'
                 ELSE 'sideways' END AS regime,
         count(strat) AS samples, avg(strat) AS avg_return,
         avg(CASE WHEN strat > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
         avg(bench) AS avg_benchmark_return
  FROM rday JOIN rpick USING ({k}event_date) GROUP BY ALL)""",
    ]


# --- ingest -----------------------------------------------------------------------

PRICE_OUT = ", ".join(r(c) for c in ["open", "high", "low", "close", "volume"])

ORACLE["bars_ohlcv"] = sql(f"SELECT symbol, {day('event_time')}, {PRICE_OUT} FROM bars", BARS)
ORACLE["kline_decode"] = ORACLE["bars_ohlcv"]
ORACLE["nav_decode"] = sql(
    f"""SELECT 'MF' || symbol AS symbol, 'Fund ' || symbol AS asset_name, {day('event_time')},
    {r('close', 'open')}, {r('close', 'high')}, {r('close', 'low')}, {r('close')},
    0.0::DOUBLE AS volume FROM bars""",
    BARS,
)
_house = " OR ".join(f"contains(lower(n), '{h.lower()}')" for h in FUND_HOUSES)
_all = " AND ".join(f"contains(n, '{w}')" for w in FUND_REQUIRED)
_none = " OR ".join(f"contains(lower(n), '{w.lower()}')" for w in FUND_EXCLUDED)
ORACLE["catalogue_filter"] = f"""SELECT p_partkey, n AS "schemeName" FROM (
  SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'HDFC' WHEN 'SMALL' THEN 'sbi'
                    WHEN 'STANDARD' THEN 'Motilal Oswal' ELSE 'Plain House' END
         || ' ' || p_name || ' ' || CASE WHEN p_size < 15 THEN 'Direct Growth'
         WHEN p_size < 25 THEN 'Regular Growth' WHEN p_size < 35 THEN 'Direct Growth idcw'
         ELSE 'direct Growth' END AS n FROM part)
WHERE ({_house}) AND {_all} AND NOT ({_none})"""
ORACLE["constituents"] = """SELECT upper(replace(p_name, ' ', '')) || '.NS' AS ticker,
  count(*) AS parts FROM part GROUP BY 1"""
ORACLE["ohlcv_normalise"] = sql(
    f"""SELECT symbol, {day('event_time')}, {r('open')}, {r('high')}, {r('low')}, {r('close')},
    CASE WHEN volume > 200 THEN volume ELSE 0.0 END AS volume,
    CASE WHEN close > 1000 THEN 'Asset ' || symbol ELSE symbol END AS asset_name
    FROM bars WHERE close >= open""",
    BARS,
)
_marks = """marks AS (SELECT symbol, max(event_time) AS mark FROM bars
  WHERE event_time <= DATE '1998-01-01' AND symbol <> 'Brand#1' GROUP BY 1)"""
for _name, _op in (("incremental_load", ">"), ("incremental_load_inclusive", ">=")):
    ORACLE[_name] = sql(
        f"""SELECT symbol, {day('event_time')}, {PRICE_OUT} FROM bars LEFT JOIN marks USING (symbol)
        WHERE event_time {_op} mark OR (mark IS NULL AND event_time >= DATE '1997-01-01')""",
        BARS,
        _marks,
    )

PAIR = """old AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
  WHERE o_orderdate < TIMESTAMP '1999-01-01'),
new AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1000 AS o_totalprice,
  '0-NEW' AS o_orderpriority FROM orders WHERE o_orderstatus <> 'O')"""
_order_out = f"o_orderkey, o_orderstatus, {r('o_totalprice')}, o_orderpriority"
ORACLE["upsert_ignore"] = sql(
    f"""SELECT {_order_out} FROM (SELECT * FROM old UNION ALL
    SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old))""",
    PAIR,
)
ORACLE["upsert_columns"] = sql(
    f"""SELECT {_order_out} FROM (
    SELECT old.o_orderkey, old.o_orderstatus, coalesce(new.o_totalprice, old.o_totalprice) AS o_totalprice,
           old.o_orderpriority FROM old LEFT JOIN new USING (o_orderkey)
    UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old))""",
    PAIR,
)
ORACLE["upsert_replace"] = sql(
    f"""SELECT {_order_out} FROM (SELECT * FROM new UNION ALL
    SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new))""",
    PAIR,
)
ORACLE["signals_upsert_twice"] = ORACLE["upsert_replace"]
ORACLE["schema_evolution"] = sql(
    f"""SELECT {_order_out} FROM (SELECT * FROM new UNION ALL
    SELECT o_orderkey, o_orderstatus, o_totalprice, NULL FROM old
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new))""",
    PAIR,
)
ORACLE["change_log"] = f"""SELECT c_custkey, operation, changed_columns,
  {r('old_acctbal')}, {r('new_acctbal')} FROM (
  SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey,
    CASE WHEN b.c_custkey IS NULL THEN 'INSERT' WHEN a.c_custkey IS NULL THEN 'DELETE'
         WHEN a.c_acctbal <> b.c_acctbal THEN 'UPDATE' END AS operation,
    CASE WHEN a.c_acctbal <> b.c_acctbal THEN 'c_acctbal' ELSE '' END AS changed_columns,
    b.c_acctbal AS old_acctbal, a.c_acctbal AS new_acctbal
  FROM (SELECT * FROM customer WHERE c_acctbal >= 0) b FULL JOIN (
    SELECT c_custkey, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END AS c_acctbal
    FROM customer WHERE c_mktsegment <> 'MACHINERY') a ON a.c_custkey = b.c_custkey)
WHERE operation IS NOT NULL"""
ORACLE["read_bounds"] = """SELECT min(o_orderkey) AS low, max(o_orderkey) AS high,
  count(*) AS row_count FROM orders"""

# --- features ---------------------------------------------------------------------

KEYS_OUT = f"symbol, {day('event_time')}"


def columns_out(names: list[str]) -> str:
    return ", ".join(r(c) for c in names)


FEATURES_OUT = columns_out(FEATURES)
ORACLE["sma_bollinger_volatility"] = sql(
    f"SELECT {KEYS_OUT}, "
    + columns_out(["sma_50", "sma_200", "moving_avg_7d", "volatility_7d", "bb_upper", "bb_lower"])
    + " FROM bands",
    BARS,
    BANDS,
)
ORACLE["ema_macd"] = sql(
    f"SELECT {KEYS_OUT}, {columns_out(['ema_20', 'macd', 'macd_signal'])} FROM trend", BARS, TREND
)
ORACLE["rsi_atr_stochastic"] = sql(
    f"SELECT {KEYS_OUT}, {columns_out(['rsi_14', 'atr_14', 'stoch_k', 'stoch_d'])} FROM osc",
    BARS,
    OSC,
)
ORACLE["feature_table"] = sql(
    f"SELECT {KEYS_OUT}, {r('close')}, {FEATURES_OUT} FROM feats WHERE sma_50 IS NOT NULL",
    *FEATURE_CTES,
)
NAV = f"""nav0 AS (
  SELECT symbol, event_time, close, lag(close, 1) {W} AS p1, lag(close, 30) {W} AS p30,
         lag(close, 90) {W} AS p90, max(close) {frame(30)} AS top30, avg(close) {frame(14)} AS m14
  FROM bars),
nav1 AS (SELECT *, CASE WHEN p1 > 0 THEN close / p1 - 1 ELSE 0 END AS dr FROM nav0),
nav2 AS (
  SELECT *, avg(dr) {frame(30)} AS mr,
         stddev_samp(CASE WHEN dr < 0 THEN dr ELSE 0 END) {frame(30)} AS ds FROM nav1),
nav AS (
  SELECT symbol, event_time, CASE WHEN p30 > 0 THEN close / p30 - 1 END AS rolling_return_30d,
         CASE WHEN p90 > 0 THEN close / p90 - 1 END AS rolling_return_90d,
         CASE WHEN ds > 1e-8 THEN mr / ds ELSE 0 END AS sortino_30d,
         CASE WHEN top30 > 0 THEN close / top30 - 1 ELSE 0 END AS max_drawdown_30d,
         CASE WHEN m14 > 0 THEN close / m14 - 1 ELSE 0 END AS nav_momentum_14d FROM nav2)"""
ORACLE["nav_feature_table"] = sql(
    f"SELECT {KEYS_OUT}, {columns_out(NAV_FEATURES)} FROM nav", BARS, NAV
)
ORACLE["warm_rows"] = sql(
    f"""SELECT {KEYS_OUT}, {columns_out(['sma_50', 'sma_200'])} FROM (
    SELECT *, row_number() {W} AS rn FROM bands) WHERE rn >= 200""",
    BARS,
    BANDS,
)
ORACLE["intraday_indicators"] = sql(
    f"SELECT {KEYS_OUT}, {FEATURES_OUT} FROM feats", EVENT_BARS, BANDS, TREND, OSC, FEATS
)
ORACLE["intraday_labels"] = sql(
    f"""SELECT {KEYS_OUT}, {r('close')}, {r('future_close')} FROM (
    SELECT *, lead(close, 252) {W} AS future_close FROM bars)""",
    EVENT_BARS,
)
ELIGIBLE = "rsi_14 IS NOT NULL AND sma_50 IS NOT NULL AND sma_200 IS NOT NULL"
ORACLE["latest_features"] = sql(
    f"""SELECT {KEYS_OUT}, {r('close')}, {FEATURES_OUT} FROM (
    SELECT DISTINCT ON (symbol) * FROM feats WHERE {ELIGIBLE} ORDER BY symbol, event_time DESC)""",
    *FEATURE_CTES,
)
ORACLE["indicator_self_check"] = sql(
    " UNION ALL ".join(
        f"""SELECT '{f}' AS indicator, count(*) AS "rows", 0.0::DOUBLE AS max_abs_diff,
        'PASS' AS status, count({f}) AS present, {r(f"avg({f})", "mean_value")} FROM feats"""
        for f in FEATURES
    ),
    *FEATURE_CTES,
)

# --- labels -----------------------------------------------------------------------

for _h, _ctes in (("1y", LAB1), ("5y", LAB5)):
    ORACLE[f"forward_labels_{_h}"] = sql(
        f"SELECT {KEYS_OUT}, {r('future_close')}, {big('target')}, {r('realized_return')} FROM labelled",
        *_ctes,
    )
ORACLE["training_profile"] = sql(
    f"""SELECT count(*) AS row_count, count(DISTINCT symbol) AS symbol_count,
    {r('avg(target)', 'positive_rate')} FROM trained""",
    *LAB1,
)
_q = ", ".join(
    f"quantile_cont({f}, 0.005) AS lo_{f}, quantile_cont({f}, 0.995) AS hi_{f}" for f in FEATURES
)
_clipped = ", ".join(
    r(f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, lo_{f}), hi_{f}) END", f)
    for f in FEATURES
)
ORACLE["winsorize_features"] = sql(
    f"SELECT {KEYS_OUT}, {_clipped} FROM feats, bounds",
    *FEATURE_CTES,
    f"bounds AS (SELECT {_q} FROM feats)",
)
_q = ", ".join(
    f"quantile_cont({f}, 0.001) AS lo_{f}, quantile_cont({f}, 0.999) AS hi_{f}" for f in FEATURES
)
_shares = " + ".join(
    f"avg(CASE WHEN {f} < lo_{f} OR {f} > hi_{f} THEN 1.0 ELSE 0.0 END)" for f in FEATURES
)
ORACLE["outlier_rate"] = sql(
    f"SELECT {r(f'({_shares}) / {len(FEATURES)}', 'outlier_rate')} FROM feats, bounds",
    *FEATURE_CTES,
    f"bounds AS (SELECT {_q} FROM feats)",
)
_probs = {"q005": 0.005, "q250": 0.25, "q500": 0.5, "q750": 0.75, "q995": 0.995}
ORACLE["feature_quantiles"] = sql(
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count({f}) AS n, "
        + ", ".join(r(f"quantile_cont({f}, {p})", n) for n, p in _probs.items())
        + " FROM feats"
        for f in FEATURES
    ),
    *FEATURE_CTES,
)
ORACLE["recency_cap"] = sql(
    f"""SELECT {KEYS_OUT}, {big('target')} FROM (
    SELECT * FROM trained ORDER BY event_time DESC, symbol DESC LIMIT 10000)""",
    *LAB1,
)
ORACLE["chrono_split"] = sql(
    f"""SELECT CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS side, {KEYS_OUT}
    FROM (SELECT symbol, event_time, row_number() OVER (ORDER BY event_time, symbol) AS i,
                 count(*) OVER () AS n FROM trained)""",
    *LAB1,
)

ORACLE["class_weights"] = sql(
    f"""SELECT {big('target')}, count(*) AS row_count,
    {r('(SELECT count(*) FROM trained) / (2.0 * count(*))', 'weight')} FROM trained GROUP BY target""",
    *LAB1,
)
ORACLE["training_gates"] = sql(
    """SELECT gate, CASE WHEN n = 0 THEN 'no_rows_after_labeling_need_252_days'
      WHEN gate = 'rows' THEN 'insufficient_rows_' || n || '_lt_1000000000'
      WHEN gate = 'symbols' THEN 'insufficient_symbols_' || s || '_lt_1000000'
      WHEN gate = 'classes' THEN 'class_imbalance_rate_' || printf('%.6f', p) || '_outside_0.01_0.0001'
      END AS reason
    FROM (SELECT count(*) AS n, count(DISTINCT symbol) AS s, avg(target) AS p FROM trained),
         (SELECT unnest(['rows', 'symbols', 'classes', 'open']) AS gate)""",
    *LAB1,
)
ORACLE["calibration_split"] = sql(
    f"""SELECT side, count(*) AS row_count, {day('min(event_time)', 'first_date')},
    {day('max(event_time)', 'last_date')} FROM (
      SELECT event_time, CASE WHEN i <= n - CAST(floor(n * 0.15) AS BIGINT) THEN 'fit' ELSE 'calibrate' END AS side
      FROM (SELECT event_time, row_number() OVER (ORDER BY event_time, symbol) AS i,
                   count(*) OVER () AS n FROM trained)) GROUP BY side""",
    *LAB1,
)
ORACLE["train_candidates"] = sql(
    """SELECT unnest([1, 2, 3])::BIGINT AS place, n - CAST(floor(n * 0.8) AS BIGINT) AS row_count,
    'histgb,logreg,rf' AS candidates, 0::BIGINT AS failed, true AS ordered, true AS possible
    FROM (SELECT count(*) AS n FROM trained)""",
    *LAB1,
)
ORACLE["ensemble_scores"] = sql(
    f"""SELECT symbol, {day('event_time', 'trade_date')}, true AS fits_1y, true AS fits_5y
    FROM (SELECT DISTINCT ON (symbol) * FROM feats WHERE {ELIGIBLE} ORDER BY symbol, event_time DESC)""",
    *FEATURE_CTES,
)
ORACLE["symbol_history"] = sql(
    f"SELECT symbol, {day('event_time')}, {PRICE_OUT} FROM bars WHERE symbol = 'Brand#11'", BARS
)

# --- signals and serving ----------------------------------------------------------


def label_case(p: str, horizon: str) -> str:
    whens = " ".join(f"WHEN {p} >= {t} THEN '{n}'" for t, n in SIGNAL_THRESHOLDS[horizon])
    return f"CASE {whens} ELSE '{SIGNAL_THRESHOLDS[horizon][-1][1]}' END"


def clip(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


_filled = ", ".join(f"coalesce({f}, 0) AS {f}" for f in FEATURES)
SIGNALS = f"""sig0 AS (
  SELECT symbol, event_time, close, {_filled} FROM feats WHERE {ELIGIBLE}),
sig1 AS (
  SELECT *, 1 / (1 + exp(-(rsi_14 - 50) / 10)) AS p1, 1 / (1 + exp(-(stoch_k - 50) / 10)) AS p5,
         CASE WHEN close > 0 THEN atr_14 / close ELSE 1.0 END AS atr_pct,
         CASE WHEN rsi_14 = 0 THEN 50 ELSE rsi_14 END AS rsi,
         CASE WHEN sma_200 <> 0 THEN (sma_50 - sma_200) / abs(sma_200) ELSE 0 END AS tr
  FROM sig0),
sig2 AS (
  SELECT *, {clip('0.65 * p1 + 0.35 * p5')} AS cc,
         {clip(f"0.40 * {clip('volatility_7d / 0.06')} + 0.30 * {clip('atr_pct / 0.08')} + 0.15 * {clip('abs(rsi - 50) / 50')} + 0.15 * {clip('-tr / 0.30')}")} AS rk
  FROM sig1),
sig3 AS (
  SELECT *, {clip(f"0.01 + 0.11 * {clip('(cc - 0.5) / 0.5')} * (1 - 0.75 * rk)", 0.01, 0.12)} AS sz,
         cc * 0.10 - (1 - cc) * 0.06 AS er,
         {clip('greatest(volatility_7d, atr_pct / sqrt(14.0), 1e-4)', 1e-4, 0.5)} AS sg
  FROM sig2),
signals AS MATERIALIZED (
  SELECT symbol, event_time AS trade_date, {label_case('p1', '1y')} AS signal, p1 AS confidence,
         {label_case('p1', '1y')} AS signal_1y, p1 AS confidence_1y,
         {label_case('p5', '5y')} AS signal_5y, p5 AS confidence_5y, cc AS combined_confidence,
         rk * 100 AS risk_score,
         CASE WHEN rk * 100 < 35 THEN 'LOW' WHEN rk * 100 < 65 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_bucket,
         sz AS suggested_position_pct, er AS expected_return_1y, er * (1 - rk) AS risk_adjusted_score,
         {clip(f"greatest(0, {Z_95} * sg - er / 252) * sz")} AS var_95_1d,
         {clip(f"greatest(0, sg * {PHI_Z_95 / 0.05} - er / 252, {Z_95} * sg - er / 252) * sz")} AS cvar_95_1d
  FROM sig3)"""
SIGNAL_CTES = [*FEATURE_CTES, SIGNALS]
_risk = ["combined_confidence", "risk_score", "suggested_position_pct", "expected_return_1y",
         "risk_adjusted_score", "var_95_1d", "cvar_95_1d"]
ORACLE["signals_scored"] = sql(
    f"""SELECT symbol, {day('trade_date')}, signal, {r('confidence')}, signal_1y, {r('confidence_1y')},
    signal_5y, {r('confidence_5y')}, risk_bucket, {columns_out(_risk)} FROM signals""",
    *SIGNAL_CTES,
)
ORACLE["signals_latest"] = sql(
    f"""SELECT symbol, {day('trade_date')}, signal_1y, signal_5y, {r('risk_adjusted_score')} FROM (
    SELECT * FROM signals WHERE trade_date < DATE '2001-06-30' UNION
    SELECT * FROM (SELECT DISTINCT ON (symbol) * FROM signals ORDER BY symbol, trade_date DESC))""",
    *SIGNAL_CTES,
)
ORACLE["api_signals"] = sql(
    f"""SELECT symbol, {day('trade_date')}, signal_1y, {r('confidence_1y')}, signal_5y,
    {r('confidence_5y')}, risk_bucket, {columns_out(_risk)} FROM (
    SELECT DISTINCT ON (symbol) * FROM signals
    WHERE confidence_1y >= 0.7 OR confidence_5y >= 0.7 OR combined_confidence >= 0.7
    ORDER BY symbol, trade_date DESC LIMIT 50)""",
    *SIGNAL_CTES,
)
LATEST = """ls AS (SELECT DISTINCT ON (symbol) * FROM signals ORDER BY symbol, trade_date DESC),
lf AS (SELECT DISTINCT ON (symbol) * FROM feats ORDER BY symbol, event_time DESC)"""
ORACLE["opportunities"] = sql(
    f"""SELECT ls.symbol AS asset_name, signal_1y, {r('confidence_1y')}, signal_5y, {r('confidence_5y')},
    signal, {r('confidence')}, risk_bucket, {columns_out(_risk)}, {r('close')}, {r('rsi_14')},
    {r('volatility_7d')}, {r('atr_14')} FROM ls JOIN lf ON ls.symbol = lf.symbol
    WHERE signal_1y IN ('INVEST NOW', 'ACCUMULATE', 'STRONG BUY', 'BUY')
       OR signal_5y IN ('INVEST NOW', 'ACCUMULATE', 'STRONG BUY', 'BUY')""",
    *SIGNAL_CTES,
    LATEST,
)
_text = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_TEXT.items())
ORACLE["market_overview"] = sql(
    f"""SELECT ls.symbol AS symbol, ls.symbol AS asset_name,
    printf('%s  (%.0f%%)', CASE signal_1y {_text} ELSE signal_1y END, confidence_1y * 100) AS outlook,
    '$' || format('{{:,.2f}}', close) AS price, round(rsi_14, 1) AS rsi_14,
    round(volatility_7d, 2) AS volatility_7d FROM ls JOIN lf ON ls.symbol = lf.symbol""",
    *SIGNAL_CTES,
    LATEST,
)
_past = ", ".join(
    f"arg_max(close, event_time) FILTER (WHERE event_time <= latest_date - INTERVAL {n} YEAR) AS p{n}"
    for n in (1, 3, 5, 10)
)
_growth = ", ".join(r(f"(latest_close - p{n}) / p{n} * 100", f"growth_{n}y") for n in (1, 3, 5, 10))
_g1 = "(latest_close - p1) / p1 * 100"
ORACLE["growth_asof"] = sql(
    f"""SELECT symbol, {day('latest_date')}, {r('latest_close')}, {_growth},
    CASE WHEN p1 IS NULL THEN 'N/A' WHEN {_g1} > 0 THEN '+' || format('{{:.2f}}%', {_g1})
         ELSE format('{{:.2f}}%', {_g1}) END AS growth_1y_text
    FROM (SELECT symbol, latest_date, latest_close, {_past} FROM bars JOIN (
            SELECT symbol, max(event_time) AS latest_date, arg_max(close, event_time) AS latest_close
            FROM bars GROUP BY 1) USING (symbol) GROUP BY ALL)""",
    BARS,
)
_money = "'$' || format('{{:,.2f}}', {0})".format
ORACLE["technical_context"] = sql(
    f"""SELECT symbol, {day('event_time')}, trend, momentum, crossover, bands,
    'Trend: ' || trend || ' (price ' || {_money('close')} ||
      CASE WHEN close > ema_20 THEN ' above' ELSE ' below' END || ' the 20-day EMA ' || {_money('ema_20')} || ')'
      || '; Momentum: ' || momentum || format(' (RSI {{:.1f}})', rsi_14)
      || CASE WHEN close > bb_upper THEN '; Volatility: above ' || {_money('bb_upper')}
              WHEN close < bb_lower THEN '; Volatility: below ' || {_money('bb_lower')} ELSE '' END AS note
    FROM (SELECT *, CASE WHEN close > ema_20 THEN 'Bullish' ELSE 'Bearish' END AS trend,
            CASE WHEN rsi_14 > 70 THEN 'Overbought' WHEN rsi_14 < 30 THEN 'Oversold' ELSE 'Neutral' END AS momentum,
            CASE WHEN macd > macd_signal THEN 'Bullish crossover' ELSE 'Bearish crossover' END AS crossover,
            CASE WHEN close > bb_upper THEN 'Above upper band' WHEN close < bb_lower THEN 'Below lower band'
                 ELSE 'Within bands' END AS bands
          FROM (SELECT DISTINCT ON (symbol) * FROM feats ORDER BY symbol, event_time DESC))""",
    *FEATURE_CTES,
)

# --- validation -------------------------------------------------------------------

_split_out = f"{big('split')}, {day('train_end')}, {day('test_start')}, {day('test_end')}"
ORACLE["walk_forward_splits"] = sql(f"SELECT {_split_out} FROM splits", *LAB1, SPLITS)
ORACLE["leakage_checks"] = sql(
    f"""SELECT {_split_out}, {big("count(*) FILTER (WHERE event_date <= train_end)", 'train_rows')},
    {big("count(*) FILTER (WHERE event_date >= test_start)", 'test_rows')},
    {big("coalesce(sum(target) FILTER (WHERE event_date <= train_end), 0)", 'train_positives')},
    {day("max(event_date) FILTER (WHERE event_date <= train_end)", 'train_max_date')},
    {day("min(event_date) FILTER (WHERE event_date >= test_start)", 'test_min_date')},
    {big("count(*) FILTER (WHERE event_date <= train_end AND event_date >= test_start)", 'overlap_rows')},
    max(event_date) FILTER (WHERE event_date <= train_end)
      >= min(event_date) FILTER (WHERE event_date >= test_start) AS date_violation
    FROM labelled JOIN splits ON event_date <= test_end
    GROUP BY splits.split, train_end, test_start, test_end""",
    *LAB1,
    SPLITS,
)
ORACLE["walk_forward_ml"] = sql(
    f"""SELECT m AS model_type, {big('split')}, {day('train_end')}, {day('test_start')}, {day('test_end')},
    train_rows, test_rows, train_positives, 0::BIGINT AS overlap_rows, false AS date_violation,
    test_rows AS scored_rows, true AS metrics_hold
    FROM (SELECT splits.split, train_end, test_start, test_end,
            count(*) FILTER (WHERE event_date <= train_end) AS train_rows,
            count(*) FILTER (WHERE event_date >= test_start) AS test_rows,
            CAST(coalesce(sum(target) FILTER (WHERE event_date <= train_end), 0) AS BIGINT) AS train_positives
          FROM labelled JOIN splits ON event_date <= test_end GROUP BY ALL),
         (SELECT unnest(['histgb', 'logreg', 'rf']) AS m)
    WHERE train_positives NOT IN (0, train_rows) AND test_rows > 0""",
    *LAB1,
    SPLITS,
)
ORACLE["key_overlap"] = sql(
    """SELECT count(*) AS overlap_rows FROM (
    SELECT symbol, event_time FROM bars WHERE event_time <= DATE '1999-12-31' INTERSECT
    SELECT symbol, event_time FROM bars WHERE event_time >= DATE '1999-07-01')""",
    BARS,
)
ORACLE["classification_metrics"] = sql(
    f"""SELECT {big('split')}, "rows", {r('accuracy')}, {r('"precision"')}, {r('recall')}, {r('f1')},
    {r('brier')}, {r('roc_auc')} FROM metrics""",
    *SPLIT_CTES,
    *metrics_ctes("tests", ["split"]),
)
ORACLE["class_report"] = sql(
    f"""SELECT class, {r('p', '"precision"')}, {r('rc', 'recall')}, {r('f', 'f1')}, {big('support')} FROM (
    SELECT CAST(c AS VARCHAR) AS class, p, rc, f, support FROM cls UNION ALL
    SELECT 'macro avg', avg(p), avg(rc), avg(f), sum(support) FROM cls UNION ALL
    SELECT 'weighted avg', sum(p * support) / sum(support), sum(rc * support) / sum(support),
           sum(f * support) / sum(support), sum(support) FROM cls)""",
    *LAB1,
    """cls AS (SELECT c, tp / called AS p, tp / support AS rc, 2.0 * tp / (called + support) AS f, support
  FROM (SELECT c, count(*) FILTER (WHERE target = c) AS support,
               count(*) FILTER (WHERE CAST(prob >= 0.5 AS INT) = c)::DOUBLE AS called,
               count(*) FILTER (WHERE target = c AND CAST(prob >= 0.5 AS INT) = c)::DOUBLE AS tp
        FROM labelled, (VALUES (0), (1)) t(c) GROUP BY c))""",
)
_edges = list(zip(BUCKET_EDGES[:-1], BUCKET_EDGES[1:]))
_buckets = ", ".join(f"({lo}::DOUBLE, {hi}::DOUBLE, '{lo:.2f}-{hi:.2f}')" for lo, hi in _edges)
ORACLE["confidence_buckets"] = sql(
    f"""SELECT {big('split')}, bucket, count(target) AS samples, {r('avg(target)', 'hit_rate')},
    {r('avg(realized_return)', 'avg_realized_return')} FROM (
      SELECT s.split, b.bucket, t.target, t.realized_return
      FROM splits s CROSS JOIN b LEFT JOIN tests t ON t.split = s.split AND t.prob >= lo AND t.prob < hi)
    GROUP BY ALL""",
    *SPLIT_CTES,
    f"b(lo, hi, bucket) AS (VALUES {_buckets})",
)
_regime_out = f"regime, samples, {r('avg_return')}, {r('hit_rate')}, {r('avg_benchmark_return')}"
REGIME_CTES = [*SPLIT_CTES, *regimes_ctes("tests", ["split"])]
ORACLE["regime_performance"] = sql(
    f"SELECT {big('split')}, {_regime_out} FROM regimes", *REGIME_CTES
)
ORACLE["backtest_periods"] = sql(
    f"""SELECT threshold, {day('event_date')}, {big('len(names)', 'picks')},
    {r('bench', 'benchmark_return')}, {r('turnover')}, {r('ret', 'period_return')} FROM periods""",
    *LAB1,
    *periods_ctes("labelled", [], [0.55]),
)
BACKTEST_CTES = [
    *SPLIT_CTES,
    *periods_ctes("tests", ["split"], [0.55]),
    stats_cte(["split", "threshold"], 252),
]
ORACLE["backtest_stats"] = sql(
    f"""SELECT {big('split')}, threshold, periods, {columns_out(STAT_COLUMNS)},
    {big('holding_period_days')} FROM stats""",
    *BACKTEST_CTES,
)
SWEEP = {
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
SWEEP_CTES = [
    *SPLIT_CTES,
    *periods_ctes("tests", ["split"], SWEEP_THRESHOLDS),
    stats_cte(["split", "threshold"], 252),
]
ORACLE["threshold_sweep"] = sql(
    "SELECT threshold, count(DISTINCT split) AS splits, "
    + ", ".join(r(f"avg({v})", k) for k, v in SWEEP.items())
    + " FROM stats GROUP BY threshold",
    *SWEEP_CTES,
)
ORACLE["threshold_sweep_splits"] = sql(
    f"""SELECT {big('split')}, threshold, periods, {columns_out(STAT_COLUMNS)},
    {big('holding_period_days')} FROM stats""",
    *SWEEP_CTES,
)
ORACLE["recommended_threshold"] = sql(
    """SELECT threshold AS recommended_min_prob FROM (
    SELECT threshold, avg(sharpe_annualized) AS a, avg(cagr_approx) AS b, avg(hit_rate) AS c
    FROM stats GROUP BY threshold)
    ORDER BY a DESC NULLS LAST, b DESC NULLS LAST, c DESC NULLS LAST, threshold LIMIT 1""",
    *SWEEP_CTES,
)
_summary = {
    "avg_accuracy": "accuracy", "avg_f1": "f1", "avg_brier": "brier", "avg_roc_auc": "roc_auc",
    **{k: v for k, v in SWEEP.items() if "period" not in k},
}
ORACLE["horizon_summary"] = sql(
    "SELECT count(*) AS splits_ran, "
    + ", ".join(r(f"avg({v})", k) for k, v in _summary.items())
    + " FROM metrics JOIN stats USING (split)",
    *BACKTEST_CTES,
    *metrics_ctes("tests", ["split"]),
)

_long = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, side, CAST({f} AS DOUBLE) AS v FROM win WHERE {f} IS NOT NULL"
    for f in FEATURES
)
DRIFT = f"""lim AS (SELECT max(event_time) AS re, max(event_time) - 62 AS rs, max(event_time) - 63 AS be,
  max(event_time) - 63 - 251 AS bs FROM feats),
win AS MATERIALIZED (
  SELECT feats.*, CASE WHEN event_time >= rs THEN 'r' ELSE 'b' END AS side
  FROM feats, lim WHERE event_time >= bs),
long AS MATERIALIZED ({_long}),
sizes AS (SELECT feature, count(*) FILTER (WHERE side = 'b') AS nb, count(*) FILTER (WHERE side = 'r') AS nr,
  avg(v) FILTER (WHERE side = 'b') AS mb, avg(v) FILTER (WHERE side = 'r') AS mr FROM long GROUP BY 1),
edges AS (SELECT feature, CASE WHEN len(u) < 3 THEN [q[1], m, q[11]] ELSE u END AS e FROM (
  SELECT feature, q, m, list_sort(list_distinct(q)) AS u FROM (
    SELECT feature, quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q, avg(v) AS m
    FROM long WHERE side = 'b' GROUP BY 1))),
binned AS (SELECT feature, side, CASE WHEN v = e[-1] THEN len(e) - 1
    ELSE len(list_filter(e, lambda x: x <= v)) END AS i
  FROM long JOIN edges USING (feature) WHERE v >= e[1] AND v <= e[-1]),
cells AS (SELECT feature, i, count(*) FILTER (WHERE side = 'b') AS b,
  count(*) FILTER (WHERE side = 'r') AS rc FROM binned GROUP BY ALL),
pct AS (SELECT feature, greatest(b / greatest(sum(b) OVER w, 1), 1e-6) AS e,
  greatest(rc / greatest(sum(rc) OVER w, 1), 1e-6) AS a FROM cells WINDOW w AS (PARTITION BY feature)),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM pct GROUP BY 1),
ks AS (SELECT feature, max(abs(cb / nb - cr / nr)) AS ks FROM (
    SELECT feature, v, sum(sum(CASE WHEN side = 'b' THEN 1.0 ELSE 0.0 END)) OVER (PARTITION BY feature ORDER BY v) AS cb,
           sum(sum(CASE WHEN side = 'r' THEN 1.0 ELSE 0.0 END)) OVER (PARTITION BY feature ORDER BY v) AS cr
    FROM long GROUP BY feature, v) JOIN sizes USING (feature) GROUP BY 1),
drift AS (SELECT *, CASE WHEN psi >= 0.25 OR ks >= 0.20 THEN 'high' WHEN psi >= 0.10 OR ks >= 0.10 THEN 'medium'
  ELSE 'low' END AS lvl FROM psi JOIN ks USING (feature) JOIN sizes USING (feature)
  WHERE nb >= 300 AND nr >= 300)"""
DRIFT_CTES = [*FEATURE_CTES, DRIFT]
ORACLE["drift_psi"] = sql(f"SELECT feature, {r('psi')} FROM psi", *DRIFT_CTES)
ORACLE["drift_ks"] = sql(
    f"""SELECT feature, nb AS baseline_n, nr AS recent_n, {r('mb', 'baseline_mean')},
    {r('mr', 'recent_mean')}, {r('ks')} FROM ks JOIN sizes USING (feature)""",
    *DRIFT_CTES,
)
ORACLE["drift_summary"] = sql(
    f"""SELECT {day('bs', 'baseline_start')}, {day('be', 'baseline_end')}, {day('rs', 'recent_start')},
    {day('re', 'recent_end')}, (SELECT count(*) FROM win WHERE side = 'b') AS baseline_rows,
    (SELECT count(*) FROM win WHERE side = 'r') AS recent_rows, (SELECT count(*) FROM drift) AS features,
    {r('(SELECT avg(psi) FROM drift)', 'avg_psi')}, {r('(SELECT avg(ks) FROM drift)', 'avg_ks')},
    (SELECT count(*) FROM drift WHERE lvl = 'high') AS high_drift_features,
    (SELECT count(*) FROM drift WHERE lvl = 'medium') AS medium_drift_features,
    CASE WHEN (SELECT count(*) FROM win WHERE side = 'b') < 300
           OR (SELECT count(*) FROM win WHERE side = 'r') < 300 THEN 'insufficient_samples'
         WHEN (SELECT count(*) FROM drift) = 0 THEN 'no_valid_features' ELSE 'ok' END AS status FROM lim""",
    *DRIFT_CTES,
)


def rollup(rows: str, keys: list[str], zero: bool) -> str:
    out = []
    for g in ("bull", "bear", "sideways"):
        here = f"CASE WHEN regime = '{g}' THEN samples END"
        out.append(f"CAST(sum({here}) AS BIGINT) AS {g}_samples")
        for m in ("hit_rate", "avg_return", "avg_benchmark_return"):
            if zero:
                x = f"sum(CASE WHEN regime = '{g}' THEN coalesce({m}, 0) * samples END) / nullif(sum({here}), 0)"
            else:
                used = f"regime = '{g}' AND {m} IS NOT NULL"
                x = (
                    f"sum(CASE WHEN {used} THEN {m} * samples END)"
                    f" / nullif(sum(CASE WHEN {used} THEN samples END), 0)"
                )
            out.append(r(x, f"{g}_{m}"))
    k = ", ".join(keys)
    return f"SELECT {k + ', ' if k else ''}{', '.join(out)} FROM {rows} {'GROUP BY ' + k if k else ''}"


THIN = """thin AS (SELECT split, regime, samples, avg_return, avg_benchmark_return,
  CASE WHEN samples >= 20 THEN hit_rate END AS hit_rate FROM regimes)"""
ORACLE["regime_rollup_api"] = sql(rollup("thin", [], False), *REGIME_CTES, THIN)
ORACLE["regime_rollup_report"] = sql(rollup("thin", [], True), *REGIME_CTES, THIN)

REPORT_CTES = [
    *LAB1,
    *metrics_ctes("labelled", ["symbol"]),
    *regimes_ctes("(SELECT *, symbol AS tab FROM labelled)", ["tab"]),
    f"rolled AS ({rollup('regimes', ['tab'], False)})",
    """hits AS (SELECT tab, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM (
  SELECT tab, event_date, coalesce(gross - 0.002 * CASE WHEN gross IS NULL THEN 0
           WHEN prev IS NULL OR prev = 0 THEN 1 ELSE 0 END, 0) AS ret FROM (
    SELECT tab, event_date, gross, lag(CASE WHEN gross IS NULL THEN 0 ELSE 1 END)
             OVER (PARTITION BY tab ORDER BY event_date) AS prev FROM (
      SELECT symbol AS tab, event_date, CASE WHEN prob >= 0.55 THEN realized_return END AS gross FROM labelled)))
  GROUP BY 1)""",
    """brands AS (SELECT DISTINCT p_brand AS tab FROM part UNION ALL SELECT r_name FROM region)""",
    """rep AS MATERIALIZED (
  SELECT brands.tab AS source_table, CASE WHEN m.symbol IS NULL THEN 'n/a' ELSE '1y' END AS horizon,
         CASE WHEN m.symbol IS NULL THEN 'missing_report' WHEN "rows" >= 1280 THEN 'ok'
              ELSE 'insufficient_history' END AS status,
         CASE WHEN m.symbol IS NOT NULL THEN 'logistic_rsi' END AS model,
         CASE WHEN m.symbol IS NOT NULL THEN 0.55::DOUBLE END AS minp,
         roc_auc, f1, brier, hit,
         CASE WHEN m.symbol IS NULL THEN NULL WHEN accuracy > 0.49 THEN 'ok' ELSE 'insufficient_samples' END AS drift_status,
         floor(brier * 40) AS hd, rolled.* EXCLUDE (tab)
  FROM brands LEFT JOIN metrics m ON m.symbol = brands.tab LEFT JOIN rolled ON rolled.tab = brands.tab
       LEFT JOIN hits ON hits.tab = brands.tab)""",
]
ORACLE["validation_summary"] = sql(
    f"""SELECT 'class ' || source_table AS asset_class, source_table, horizon, status,
    model AS selected_model_type, minp AS recommended_min_prob, {r('roc_auc', 'avg_roc_auc')}, {r('f1', 'avg_f1')},
    {r('brier', 'avg_brier')}, {r('hit', 'avg_hit_rate')}, drift_status, hd AS drift_high_features,
    bull_samples, bull_hit_rate, bear_samples, bear_avg_return, sideways_samples,
    sideways_avg_benchmark_return FROM rep""",
    *REPORT_CTES,
)


def _pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n/a' ELSE format('{{:.1f}}%', {x} * 100) END"


_lines_rollup = rollup("regimes", ["tab"], True).replace("round(CAST(", "(CAST(").replace(", 4) + 0.0", ")")
ORACLE["validation_lines"] = sql(
    f"""SELECT 'class ' || source_table AS asset_class, horizon,
    '- class ' || source_table || ' [' || horizon || ']: ' || CASE WHEN status <> 'ok' THEN 'status=' || status ELSE
      'model=logistic_rsi, threshold=55%, ROC-AUC=' || format('{{:.3f}}', roc_auc) || ', F1=' || format('{{:.3f}}', f1)
      || ', splits=1, drift=' || drift_status || ' (high=' || CAST(CAST(hd AS BIGINT) AS VARCHAR) || ', medium=1), hit-rate bull/bear/sideways='
      || {_pct('z.bull_hit_rate')} || '/' || {_pct('z.bear_hit_rate')} || '/' || {_pct('z.sideways_hit_rate')} END AS line
    FROM rep LEFT JOIN z ON z.tab = rep.source_table""",
    *REPORT_CTES,
    f"z AS ({_lines_rollup})",
)

# --- guards and audit -------------------------------------------------------------

ORACLE["promotion_gate"] = sql(
    f"""SELECT source_table, '1y' AS horizon,
    CASE WHEN status <> 'missing_report' THEN 6.0::DOUBLE END AS report_age_days,
    {r('roc_auc', 'avg_roc_auc')}, {r('f1', 'avg_f1')}, hd AS high_drift_features, reason,
    CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS gate_status FROM (
    SELECT *, CASE WHEN status = 'missing_report' THEN 'missing_report' WHEN status <> 'ok' THEN 'status_not_ok'
      WHEN roc_auc IS NULL OR roc_auc < 0.45 THEN 'low_roc_auc' WHEN f1 IS NULL OR f1 < 0.40 THEN 'low_f1'
      WHEN drift_status <> 'ok' THEN 'drift_not_ok' WHEN hd > 10 THEN 'high_drift' END AS reason FROM rep)""",
    *REPORT_CTES,
)
WRITES = """w AS (SELECT 'user_' || user_id AS source_table,
  CASE event_type WHEN 'view' THEN 'walk_forward_summary.json' WHEN 'click' THEN 'walk_forward_splits.csv'
    WHEN 'signup' THEN 'walk_forward_buckets.csv' WHEN 'purchase' THEN 'walk_forward_thresholds.csv'
    ELSE 'walk_forward_model_compare.csv' END AS artifact, ts, value > 5 AS hz FROM events),
chk AS (SELECT t.source_table, a.artifact, n.ts IS NULL AS is_missing,
  coalesce(n.ts < TIMESTAMP '2024-01-25', FALSE) AS is_stale,
  n.ts IS NOT NULL AND a.artifact = 'walk_forward_summary.json' AND NOT n.hz AS is_invalid
  FROM (SELECT DISTINCT source_table FROM w) t CROSS JOIN (VALUES ('walk_forward_summary.json'),
    ('walk_forward_splits.csv'), ('walk_forward_buckets.csv'), ('walk_forward_thresholds.csv'),
    ('walk_forward_model_compare.csv'), ('walk_forward_regimes.csv'), ('walk_forward_drift.csv')) a(artifact)
  LEFT JOIN (SELECT source_table, artifact, max(ts) AS ts, arg_max(hz, ts) AS hz FROM w GROUP BY ALL) n
    ON n.source_table = t.source_table AND n.artifact = a.artifact)"""
ORACLE["report_completeness"] = sql(
    "SELECT source_table, artifact, is_missing, is_stale, coalesce(is_invalid, FALSE) AS is_invalid FROM chk",
    WRITES,
)


def _sample(flag: str) -> str:
    return (
        f"(SELECT coalesce(string_agg(n, ',' ORDER BY n), '') FROM (SELECT source_table || '/' || artifact AS n "
        f"FROM chk WHERE is_{flag} ORDER BY n LIMIT 3)) AS {flag}_sample"
    )


ORACLE["report_completeness_summary"] = sql(
    f"""SELECT count(*) FILTER (WHERE is_missing) AS missing, count(*) FILTER (WHERE is_stale) AS stale,
    count(*) FILTER (WHERE is_invalid) AS invalid, {_sample('missing')}, {_sample('stale')}, {_sample('invalid')},
    CASE WHEN count(*) FILTER (WHERE is_missing OR is_stale OR is_invalid) > 0 THEN 'failed' ELSE 'ok' END AS status
    FROM chk""",
    WRITES,
)
RUNS = """runs AS (SELECT 'user_' || user_id AS source_table,
  CASE WHEN value < 20 THEN '1y' WHEN value < 60 THEN '5y' ELSE 'unknown' END AS horizon, event_type,
  json_extract_string(props, '$.k') AS k, ts FROM events),
gates AS (SELECT * FROM (
  SELECT source_table, horizon, CASE event_type WHEN 'error' THEN 'schema' ELSE 'freshness' END AS gate_type,
    CASE event_type WHEN 'error' THEN 'missing_columns=c' || k ELSE 'age_days=' || k END AS gate_detail, event_type
  FROM (SELECT DISTINCT ON (source_table, horizon) * FROM runs ORDER BY source_table, horizon, ts DESC))
  WHERE event_type IN ('error', 'signup'))"""
ORACLE["gate_failures"] = sql(
    """SELECT gate_type, gate_detail, gate_type || '_gate_failed_' || gate_detail AS reason,
    source_table, horizon FROM gates""",
    RUNS,
)


def _fresh(name: str, time: str, label: str = "") -> str:
    age = f"(epoch_us(TIMESTAMP '2024-02-02') - epoch_us(max({time}))) / 3.6e9"
    reason = f"CASE WHEN count(*) < 100 THEN 'too_few_rows' WHEN max({time}) IS NULL THEN 'no_timestamp' WHEN {age} > 72 THEN 'stale' END"
    return (
        f"SELECT {label}count(*) AS row_count, {r(age, 'age_hours')}, {reason} AS reason, "
        f"CASE WHEN {reason} IS NULL THEN 'ok' ELSE 'failed' END AS status FROM {name}"
    )


ORACLE["freshness_sla"] = _fresh("events", "ts")
ORACLE["freshness_by_table"] = " UNION ALL ".join(
    _fresh(n, t, f"'{n}' AS table_name, ")
    for n, t in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
)
LOG = """log AS (SELECT CAST(event_id AS VARCHAR) AS audit_id, event_type AS job, ts AS start_time,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
  value AS duration_seconds, user_id AS rows_inserted, user_id % 7 AS rows_updated,
  user_id % 3 AS rows_deleted FROM events),
daily AS (SELECT CAST(start_time AS DATE) AS run_date, count(*) AS total_tasks,
  count(*) FILTER (WHERE status = 'SUCCESS') AS successful_tasks,
  count(*) FILTER (WHERE status = 'FAILED') AS failed_tasks,
  count(*) FILTER (WHERE status = 'PARTIAL') AS partial_tasks,
  CAST(sum(rows_inserted) AS BIGINT) AS total_rows_inserted,
  CAST(sum(rows_updated) AS BIGINT) AS total_rows_updated,
  CAST(sum(rows_deleted) AS BIGINT) AS total_rows_deleted,
  avg(duration_seconds) AS avg_duration_seconds, max(duration_seconds) AS max_duration_seconds
  FROM log WHERE CAST(start_time AS DATE) >= DATE '2024-01-31' - 30 GROUP BY 1)"""
ORACLE["audit_summary"] = sql(
    f"SELECT * EXCLUDE (run_date, avg_duration_seconds, max_duration_seconds), {day('run_date')}, "
    f"{r('avg_duration_seconds')}, {r('max_duration_seconds')} FROM daily",
    LOG,
)
ORACLE["audit_run_summary"] = sql(
    """SELECT 7::BIGINT AS period_days, count(*) AS total_runs,
    count(*) FILTER (WHERE failed_tasks = 0) AS successful_runs,
    count(*) FILTER (WHERE failed_tasks > 0) AS failed_runs,
    (SELECT count(*) FROM gates) AS gate_failures,
    CASE WHEN count(*) FILTER (WHERE failed_tasks > 0) > 0 THEN 'FAIL'
         WHEN (SELECT count(*) FROM gates) > 0 THEN 'WARN' ELSE 'PASS' END AS report_status
    FROM daily WHERE run_date >= DATE '2024-01-31' - 7""",
    LOG,
    RUNS,
)
_pairs = [("orders", "customer"), ("lineitem", "orders"), ("part", "supplier"), ("orders", "orders")]
RECON = "recon0 AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS source_table, '{t}' AS target_table, (SELECT count(*) FROM {s}) AS sc, (SELECT count(*) FROM {t}) AS tc"
    for s, t in _pairs
) + """), recon AS (SELECT *, CASE WHEN sc = 0 THEN 0 ELSE abs(tc - sc) * 100.0 / sc END AS v FROM recon0)"""
_status = "CASE WHEN v < 0.5 THEN 'PASS' WHEN v < 5 THEN 'WARN' ELSE 'FAIL' END"
ORACLE["reconcile_counts"] = sql(
    f"""SELECT source_table, target_table, '2024-01-31' AS reconciliation_date, sc AS source_row_count,
    tc AS target_row_count, tc - sc AS row_count_difference, {r('v', 'row_count_variance_percent')},
    v < 1 AS row_count_match, {_status} AS reconciliation_status FROM recon""",
    RECON,
)
ORACLE["reconciliation_view"] = sql(
    f"""SELECT source_table, target_table, {r('v', 'row_count_variance_percent')}, {_status} AS reconciliation_status,
    CASE WHEN v < 1 THEN 'PASS' ELSE 'FAIL' END AS data_integrity_status,
    CASE WHEN v < 1 THEN 'PASS' WHEN v < 5 THEN 'WARN' ELSE 'FAIL' END AS task_status FROM recon""",
    RECON,
)
ORACLE["daily_audit_report"] = sql(
    f"""SELECT section AS report_section, metric AS metric_name, CAST(x AS VARCHAR) AS metric_value FROM (
    SELECT 'ETL Summary' AS section, 'Total Tasks Run' AS metric, count(*) AS x FROM d UNION ALL
    SELECT 'ETL Summary', 'Successful Tasks', count(*) FROM d WHERE status = 'SUCCESS' UNION ALL
    SELECT 'ETL Summary', 'Failed Tasks', count(*) FROM d WHERE status = 'FAILED' UNION ALL
    SELECT 'Data Quality', 'Tables Checked', 2 UNION ALL
    SELECT 'Data Quality', 'Tables with Issues', CAST((SELECT count(*) > count(DISTINCT o_orderkey) FROM orders) AS INT)
       + CAST((SELECT count(*) > count(DISTINCT l_orderkey) FROM lineitem) AS INT) UNION ALL
    SELECT 'Reconciliation', 'Passed Checks', count(*) FROM recon WHERE {_status} = 'PASS' UNION ALL
    SELECT 'Reconciliation', 'Failed Checks', count(*) FROM recon WHERE {_status} = 'FAIL')""",
    LOG,
    RECON,
    "d AS (SELECT * FROM log WHERE CAST(start_time + INTERVAL 1 DAY AS DATE) = DATE '2024-01-31')",
)
ORACLE["failed_tasks"] = sql(
    f"""SELECT audit_id, job, {day('start_time')}, status, {r('duration_seconds')} FROM log
    WHERE status = 'FAILED' AND CAST(start_time AS DATE) >= DATE '2024-01-31' - 7""",
    LOG,
)
ORACLE["reconcile_keys"] = """SELECT count(s) AS source_keys, count(t) AS target_keys,
  count(*) FILTER (WHERE s IS NULL) AS orphaned_records, count(*) FILTER (WHERE t IS NULL) AS missing_records
  FROM (SELECT DISTINCT l_orderkey AS s FROM lineitem) FULL JOIN
       (SELECT DISTINCT o_orderkey AS t FROM orders WHERE o_orderstatus <> 'P') ON s = t"""
STATES = """st AS (SELECT DISTINCT ON (audit_id) * FROM (
  SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS audit_id,
    CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    event_type, ts, CAST(floor(value * 100) AS BIGINT) AS rin, CAST(floor(value * 90) AS BIGINT) AS rout FROM events)
  ORDER BY audit_id, ts DESC)"""
ORACLE["audit_current_state"] = sql(
    "SELECT audit_id, status, event_type AS source_table, rin AS rows_source FROM st", STATES
)
ORACLE["table_lineage"] = sql(
    f"""SELECT audit_id, event_type AS source_table, 'gold' AS target_table, rin AS rows_in, rout AS rows_out,
    {r('CASE WHEN rin = 0 THEN 0 ELSE (rin - rout) * 100.0 / rin END', 'loss_percent')},
    {day('ts', 'end_time')} FROM st WHERE status = 'SUCCESS'""",
    STATES,
)


def profile(select: str, keys: list[str], table: str, columns: list[str], value: str | None) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    anyn = " OR ".join(f"{c} IS NULL" for c in columns)
    v = value or "NULL::DOUBLE"
    return f"""SELECT *, total_rows - unique_rows AS duplicate_rows,
  round(100.0 - nv * 100.0 / (total_rows * {len(columns)}), 2) AS data_completeness_percent,
  round(unique_rows * 100.0 / total_rows, 2) AS data_uniqueness_percent
  FROM (SELECT '{table}' AS table_name, count(*) AS total_rows, count(DISTINCT ({', '.join(keys)})) AS unique_rows,
    count(*) FILTER (WHERE {anyn}) AS null_rows, {nulls} AS nv, min({v}) AS min_value, max({v}) AS max_value,
    avg({v}) AS mean_value, stddev_samp({v}) AS stddev_value FROM {select})"""


CUST = """cust AS (SELECT * EXCLUDE (c_acctbal), CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer)"""
_cust_columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_table_columns = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}
SCORED = """scoredp AS (SELECT *, round((data_completeness_percent + data_uniqueness_percent) / 2, 2) AS quality_score,
  CAST(null_rows > 0 AS BIGINT) + CAST(duplicate_rows > 0 AS BIGINT) AS issue_count FROM prof)"""
STATUS = """CASE WHEN quality_score >= 99 THEN 'EXCELLENT' WHEN quality_score >= 95 THEN 'GOOD'
  WHEN quality_score >= 80 THEN 'FAIR' ELSE 'POOR' END AS quality_status"""
_cust_profile = profile("cust", ["c_mktsegment", "c_nationkey"], "customer", _cust_columns, "c_acctbal")
PROF = [CUST, f"prof AS ({_cust_profile})", SCORED]
ORACLE["quality_profile"] = sql(
    f"""SELECT table_name, '2024-01-31' AS check_date, total_rows, unique_rows, duplicate_rows, null_rows,
    data_completeness_percent, data_uniqueness_percent, {r('min_value')}, {r('max_value')}, {r('mean_value')},
    {r('stddev_value')}, issue_count > 0 AS issues_found, issue_count, quality_score, {STATUS} FROM scoredp""",
    *PROF,
)
ORACLE["quality_columns"] = sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"{r(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)', 'null_percent')}, "
        f"count(DISTINCT {c}) AS unique_count FROM cust"
        for c in _cust_columns
    ),
    CUST,
)
ORACLE["quality_issues"] = sql(
    f"""SELECT table_name, 'null_values' AS issue, null_rows AS "count", {r('null_rows * 100.0 / total_rows', '"percent"')}
    FROM prof WHERE null_rows > 0 UNION ALL
    SELECT table_name, 'duplicate_rows', duplicate_rows, round(duplicate_rows * 100.0 / total_rows, 4)
    FROM prof WHERE duplicate_rows > 0""",
    *PROF,
)
_keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "supplier": "s_suppkey"}
ALLPROF = [
    CUST,
    "prof AS ("
    + " UNION ALL ".join([_cust_profile, *[profile(t, [_keys[t]], t, c, None) for t, c in _table_columns.items()]])
    + ")",
    SCORED,
]
ORACLE["quality_gate"] = sql(
    """SELECT table_name, data_completeness_percent, data_uniqueness_percent,
    CASE WHEN data_completeness_percent >= 95 AND data_uniqueness_percent >= 99 THEN 'PASS' ELSE 'WARN' END AS gate_status
    FROM scoredp UNION ALL SELECT 'region', NULL, NULL, 'NO_DATA'""",
    *ALLPROF,
)
ORACLE["quality_dashboard"] = sql(
    f"""SELECT table_name, '2024-01-31' AS check_date, total_rows, quality_score, {STATUS}, issue_count FROM scoredp""",
    *ALLPROF,
)


# --- stored versions, appended features, artifacts ----------------------------------

ORACLE["versioned_merge"] = sql(
    f"""SELECT {_order_out} FROM (
    SELECT o_orderkey, o_orderstatus, o_totalprice,
           CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority FROM new
    UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, NULL FROM old
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new))""",
    PAIR,
)
ORACLE["incremental_features"] = sql(
    f"""SELECT {KEYS_OUT}, {r('close')}, {FEATURES_OUT} FROM feats
    WHERE event_time > (SELECT max(event_time) FROM bars) - 60""",
    *FEATURE_CTES,
)
_p1, _p5 = "1 / (1 + exp(-(rsi_14 - 50) / 10)) AS p1", "1 / (1 + exp(-(stoch_k - 50) / 10)) AS p5"
NAV_BARS = f"""{BARS.replace('bars AS', 'raw_bars AS', 1)},
bars AS MATERIALIZED (
  SELECT symbol, event_time, close AS open, close AS high, close AS low, close, 0.0 AS volume
  FROM raw_bars)"""
_newest = "SELECT DISTINCT ON (symbol) * FROM signals ORDER BY symbol, trade_date DESC"
ORACLE["fund_signals"] = sql(
    f"""SELECT symbol, {day('trade_date')}, signal_1y, signal_5y, {r('confidence_1y')},
    {r('risk_adjusted_score')} FROM ({_newest})""",
    NAV_BARS, BANDS, TREND, OSC, FEATS, NAV,
    SIGNALS.replace(
        f"{_filled} FROM feats WHERE",
        f"{_filled}, coalesce(nav_momentum_14d, 0) AS nm FROM feats JOIN nav USING (symbol, event_time) WHERE",
    ).replace(_p1, "1 / (1 + exp(-nm * 10)) AS p1"),
)
ORACLE["fallback_signals"] = sql(
    f"""SELECT symbol, {day('trade_date')}, signal_1y, signal_5y, {r('combined_confidence')},
    {r('risk_adjusted_score')} FROM ({_newest})""",
    *FEATURE_CTES,
    SIGNALS.replace(_p1, "0.0::DOUBLE AS p1").replace(_p5, "0.0::DOUBLE AS p5"),
)
_vote = clip("(0.8 / (1 + exp(-(rsi_14 - 50) / 10)) + 0.01 / (1 + exp(-(stoch_k - 50) / 10))) / 0.81")
ORACLE["ensemble_vote"] = sql(
    f"""SELECT symbol, {day('event_date')}, {r('prob')}, {label_case('prob', '1y')} AS label
    FROM (SELECT symbol, event_date, {_vote} AS prob FROM labelled)""",
    *LAB1,
)
ORACLE["training_registry"] = """SELECT DISTINCT ON (source_table, horizon)
  CAST(event_id AS VARCHAR) AS run_id, 'user_' || user_id AS source_table,
  CASE WHEN value < 20 THEN '1y' ELSE '5y' END AS horizon, event_type AS status
FROM events ORDER BY source_table, horizon, ts DESC, CAST(event_id AS VARCHAR) DESC"""
ORACLE["boost_stopping"] = sql(
    """SELECT count(*) AS row_count, count(*) FILTER (
      substr(md5(symbol || '|' || CAST(event_time AS VARCHAR) || '|42'), 1, 6) < '199999') AS held_rows,
    true AS kept_to_the_best FROM trained""",
    *LAB1,
)

# Other ways to the same rows.
for _name, _same in (
    ("incremental_load_ledger", "incremental_load"),
    ("change_log_digest", "change_log"),
    ("reconcile_keys_digest", "reconcile_keys"),
    ("drift_psi_daily", "drift_psi"),
    ("feature_quantiles_daily", "feature_quantiles"),
):
    ORACLE[_name] = ORACLE[_same]
