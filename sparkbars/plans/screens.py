"""Queries over snapshots, screens, breadth, rankings and cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import latest, latest_date
from ..operators import market as m
from ..operators import scale
from ..operators import snapshot as s
from ..operators import windows as w
from .base import B1, B2, B3, MASTER, W, Tables, over, query
from .indicators import GAPS, RSI_CUTLER_SQL, _flow_sql, _sma_sql

# Technicals over one bar view; the Spark side computes the same columns with one window chain.
TECH = GAPS + f""",
t1 AS (SELECT *, adj - LAG(adj) {W} AS diff, LN(adj / LAG(adj) {W}) AS lr, fbuy - fsell AS net,
  CASE WHEN fbuy + fsell > 0 THEN 1 ELSE 0 END AS act, CASE WHEN ref > 0 THEN GREATEST(high - low, ABS(high - ref), ABS(low - ref)) / ref * 100 END AS trp,
  CASE WHEN ref > 0 AND c1 > 0 AND ABS(ref / c1 - 1) >= 0.05 THEN 1 ELSE 0 END AS gapev,
  CASE WHEN volume > 0 THEN 0 ELSE 1 END AS idle,
  CASE WHEN prev > 0 AND value > 0 THEN ABS(close / prev - 1) * 100 / (value / 1e9) END AS imp FROM adjusted),
t2 AS (SELECT *, {', '.join(f"CASE WHEN LAG(adj, {n}) {W} > 0 THEN (adj / LAG(adj, {n}) {W} - 1) * 100 END AS ret_{n}" for n in (1, 5, 20, 60))},
  {_sma_sql(20)} AS sma20, {_sma_sql(50)} AS sma50, {_sma_sql(200)} AS sma200, {RSI_CUTLER_SQL} AS rsi14,
  CASE WHEN COUNT(trp) {over(-13)} = 14 THEN AVG(trp) {over(-13)} END AS atr14_pct,
  CASE WHEN rn >= 21 THEN STDDEV_POP(lr) {over(-19)} * SQRT(252) * 100 END AS volatility20,
  CASE WHEN rn > 20 THEN AVG(volume) {over(-20, -1)} END AS avg_volume_20, CASE WHEN rn > 20 THEN AVG(value) {over(-20, -1)} END AS avg_value_20,
  CASE WHEN rn > 20 THEN AVG(freq) {over(-20, -1)} END AS avg_freq_20,
  {_flow_sql(5)}, {_flow_sql(20)},
  COALESCE(rn > 20 AND adj > MAX(adj_high) {over(-20, -1)}, FALSE) AS breakout_20, COALESCE(rn > 20 AND adj < MIN(adj_low) {over(-20, -1)}, FALSE) AS new_low_20,
  CASE WHEN rn >= 20 THEN AVG(imp) {over(-19)} END AS price_impact_20, CASE WHEN rn >= 20 THEN (1 - AVG(idle) {over(-19)}) * 100 END AS active_pct_20,
  SUM(gapev) {over('-')} AS gap_events FROM t1),
t3 AS (SELECT *, CASE WHEN avg_volume_20 > 0 THEN volume / avg_volume_20 END AS volume_ratio, CASE WHEN avg_value_20 > 0 THEN value / avg_value_20 END AS value_ratio,
  CASE WHEN avg_freq_20 > 0 THEN freq / avg_freq_20 END AS freq_ratio, CASE WHEN avg_volume_20 > 0 THEN volume / avg_volume_20 END AS confirmation_ratio,
  CASE WHEN adj > sma20 AND sma20 > sma50 THEN 'Uptrend' WHEN adj < sma20 AND sma20 < sma50 THEN 'Downtrend' ELSE 'Sideways' END AS trend,
  CASE WHEN rsi14 IS NULL THEN 'Insufficient data' WHEN rsi14 >= 70 THEN 'Overbought' WHEN rsi14 <= 30 THEN 'Oversold' WHEN rsi14 >= 50 THEN 'Positive' ELSE 'Negative' END AS momentum,
  CASE WHEN COALESCE(avg_value_20, 0) >= 5e10 THEN 'High' WHEN COALESCE(avg_value_20, 0) >= 1e10 THEN 'Medium' ELSE 'Low' END AS liquidity FROM t2),
tech AS (SELECT *, CASE WHEN rn >= 50 THEN 20 * COALESCE(CAST(adj > sma20 AS INT), 0) + 20 * COALESCE(CAST(sma20 > sma50 AS INT), 0)
  + 15 * COALESCE(CAST(ret_20 > 0 AS INT), 0) + 10 * COALESCE(CAST(ret_1 > 0 AS INT), 0)
  + 10 * COALESCE(CAST(confirmation_ratio >= 1.2 AND ret_1 > 0 AS INT), 0) + 15 * COALESCE(CAST(net_20d > 0 AS INT), 0)
  + 10 * COALESCE(CAST(rsi14 BETWEEN 50 AND 70 AS INT), 0) END AS score,
  20 * CAST(sma20 IS NOT NULL AS INT) + 20 * CAST(sma50 IS NOT NULL AS INT) + 15 * CAST(ret_20 IS NOT NULL AS INT) + 10 * CAST(ret_1 IS NOT NULL AS INT)
  + 10 * CAST(confirmation_ratio IS NOT NULL AND ret_1 IS NOT NULL AS INT) + 15 * CAST(net_20d IS NOT NULL AS INT) + 10 * CAST(rsi14 IS NOT NULL AS INT) AS score_coverage,
  (CAST(ret_20 IS NOT NULL AS INT) + CAST(ret_60 IS NOT NULL AS INT) + CAST(sma20 IS NOT NULL AS INT) + CAST(sma50 IS NOT NULL AS INT)
  + CAST(sma200 IS NOT NULL AS INT) + CAST(rsi14 IS NOT NULL AS INT) + CAST(atr14_pct IS NOT NULL AS INT) + CAST(volatility20 IS NOT NULL AS INT)
  + CAST(net_20d IS NOT NULL AS INT)) / 9 * 100 AS indicator_coverage,
  list_filter([CASE WHEN breakout_20 THEN 'Breakout 20D' END, CASE WHEN confirmation_ratio >= 1.5 THEN 'Activity spike' END, CASE WHEN value_ratio >= 1.5 THEN 'Value spike' END,
    CASE WHEN net_20d > 0 AND consistency_20 >= 60 THEN 'Foreign accumulation' END, CASE WHEN rsi14 <= 30 THEN 'Oversold' END], lambda x: x IS NOT NULL) AS tags,
  list_filter([CASE WHEN volume <= 0 THEN 'No trade in the latest session' END, CASE WHEN rn < 200 THEN 'History too short for SMA200' END,
    CASE WHEN gap_events > 0 THEN CAST(CAST(gap_events AS BIGINT) AS VARCHAR) || ' reference price adjustments applied' END,
    CASE WHEN COALESCE(active_pct_20, 0) < 60 THEN 'Trading is not consistent' END], lambda x: x IS NOT NULL) AS quality_flags FROM t3)"""
T1, T2, T3 = B1 + ",\n" + TECH, B2.replace("dense AS (", "dense0 AS (") + ",\nbarsd AS (SELECT * FROM dense0),\n" + TECH.replace("FROM bars)", "FROM barsd)"), B3 + ",\n" + TECH
LAST = "last AS (SELECT * FROM tech QUALIFY d = MAX(d) OVER (PARTITION BY sym))"
# History cut to the last 261 market sessions before anything is computed.
CUT = """cut AS (SELECT * FROM (SELECT *, DENSE_RANK() OVER (ORDER BY d DESC) AS day_back FROM bars0) WHERE day_back <= 261),
bars AS (SELECT * REPLACE (ROW_NUMBER() OVER (PARTITION BY sym ORDER BY d) AS rn) FROM cut)"""
T3_CUT = B3.replace("\nbars AS (", "\nbars0 AS (") + ",\n" + CUT + ",\n" + TECH

SNAP_SPEC = ("sym d:date close:4 rn ret_1:6 ret_5:6 ret_20:6 ret_60:6 sma20:4 sma50:4 sma200:4 rsi14:6 atr14_pct:6 volatility20:6 "
             "avg_volume_20:4 avg_value_20:4 volume_ratio:6 value_ratio:6 freq_ratio:6 confirmation_ratio:6 net_5d:2 net_20d:2 "
             "consistency_20:6 net_volume_pct_20:6 breakout_20:int new_low_20:int price_impact_20:4 trend momentum liquidity "
             "score:2 score_coverage:int indicator_coverage:6 tags:arr quality_flags:arr")


@query("market_snapshot", "K1 K2 K3 K4 P7", SNAP_SPEC,
       T3_CUT + ", q AS (SELECT * FROM tech WHERE d = (SELECT MAX(d) FROM bars))")
def _(t: Tables):
    return s.snapshot(t.brand_bars())


@query("symbol_snapshot", "K1 K2 K3 K4 P6", SNAP_SPEC, T1 + ", " + LAST + ", q AS (SELECT * FROM last)")
def _(t: Tables):
    return s.snapshot(t.bars(), per="sym")


@query("top_condition_scores", "K1 K3", "rank sym d:date adj:4 score:2 score_coverage:int ret_1:6 ret_20:6 rsi14:6 trend",
       T1 + ", " + LAST + """, q AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, sym) AS rank FROM last WHERE score IS NOT NULL
         QUALIFY rank <= 25)""")
def _(t: Tables):
    best = s.snapshot(t.bars(), per="sym").filter(F.col("score").isNotNull())
    return scale.top_n(best, [F.desc("score"), F.asc("sym")], 25)


@query("score_components", "K3", "sym d:date key weight:int available:int passed:int points:int",
       T1 + ", " + LAST + """, parts AS (SELECT sym, d, UNNEST([
         {'key': 'price_above_sma20', 'weight': 20, 'ok': adj > sma20}, {'key': 'sma20_above_sma50', 'weight': 20, 'ok': sma20 > sma50},
         {'key': 'return_20d_positive', 'weight': 15, 'ok': ret_20 > 0}, {'key': 'return_1d_positive', 'weight': 10, 'ok': ret_1 > 0},
         {'key': 'volume_confirmation', 'weight': 10, 'ok': CASE WHEN confirmation_ratio IS NOT NULL AND ret_1 IS NOT NULL THEN confirmation_ratio >= 1.2 AND ret_1 > 0 END},
         {'key': 'foreign_net_positive', 'weight': 15, 'ok': net_20d > 0}, {'key': 'rsi_positive_zone', 'weight': 10, 'ok': rsi14 BETWEEN 50 AND 70}]) AS p FROM last),
       q AS (SELECT sym, d, p.key AS key, p.weight AS weight, p.ok IS NOT NULL AS available, COALESCE(p.ok, FALSE) AS passed,
         CASE WHEN p.ok THEN p.weight ELSE 0 END AS points FROM parts)""")
def _(t: Tables):
    snap = s.snapshot(t.bars(), per="sym")
    return snap.select("sym", "d", F.explode("score_parts").alias("p")).select("sym", "d", "p.*")


# The given tables trade far less money than the presets expect, so values are scaled to their size.
def _scaled(t: Tables):
    return s.technicals(t.brand_bars()).withColumn("avg_value_20", F.col("avg_value_20") * 1e6)


PRESET_SQL = {
    "momentum": "adj > sma20 AND sma20 > sma50 AND rsi14 BETWEEN 50 AND 70 AND ret_20 > 0 AND v >= 1e10",
    "breakout": "breakout_20 AND confirmation_ratio >= 1.5 AND v >= 1e10",
    "volume": "volume_ratio >= 1.5 AND value_ratio >= 1.5 AND freq_ratio >= 1.5",
    "foreign": "net_volume_pct_20 > 0 AND consistency_20 >= 60 AND v >= 1e10",
    "oversold": "rsi14 <= 30 AND v >= 1e9",
    "liquid": "v >= 5e10 AND active_pct_20 >= 90",
}


@query("screener_presets", "K5", "preset sym d:date score:2",
       T3 + ", sc AS (SELECT *, COALESCE(avg_value_20, 0) * 1e6 AS v FROM tech), q AS (" + " UNION ALL ".join(
           f"SELECT '{k}' AS preset, sym, d, score FROM sc WHERE {cond}" for k, cond in PRESET_SQL.items()) + ")")
def _(t: Tables):
    df = _scaled(t)
    rules = s.presets()
    hits = F.explode(s.keep(*[(rules[k], k) for k in PRESET_SQL]))
    return df.select("sym", "d", "score", hits.alias("preset"))


@query("screener_search_sort", "K5 X9", "sym d:date trend score:2",
       T1 + ", " + LAST + """, q AS (SELECT * FROM last WHERE trend = 'Uptrend' AND sym LIKE '%1%')""")
def _(t: Tables):
    return s.screen(s.snapshot(t.bars(), per="sym"), search="1", trend="Uptrend")


@query("symbol_history", "K6", "sym d:date adj:4 sma20:4 sma50:4 rsi14:6 official_return:6 is_adjusted:int resistance_20:4 support_55:4 high_52w:4",
       T1 + f""", q AS (SELECT *, CASE WHEN ref > 0 THEN (close / ref - 1) * 100 END AS official_return, ABS(adj / close - 1) > 1e-9 AS is_adjusted,
         MAX(adj_high) {over(-19)} AS resistance_20, MIN(adj_low) {over(-54)} AS support_55, MAX(adj_high) {over(-251)} AS high_52w
         FROM tech QUALIFY COUNT(*) OVER (PARTITION BY sym) - rn < 260)""")
def _(t: Tables):
    return s.stock_history(t.bars(), 260)


@query("watchlist_signals", "K11 W14", "pos sym d:date close:4 change_pct:6 rsi14:6 atr:4 trend signal take_profit:4 stop_loss:4 high_52w:4 low_52w:4 vol_ratio:6",
       B1 + f""", codes AS (SELECT s_suppkey + 1 AS pos, 'S' || CAST(s_suppkey AS VARCHAR) AS sym FROM supplier
         UNION ALL SELECT 0 AS pos, 'NONE' AS sym),
       df AS (SELECT *, close - LAG(close) {W} AS diff FROM bars),
       x AS (SELECT *, {_sma_sql(20, 'close')} AS s20, {_sma_sql(50, 'close')} AS s50, CASE WHEN rn >= 15 THEN AVG(ABS(diff)) {over(-13)} END AS atr,
         CASE WHEN rn < 15 THEN NULL WHEN SUM(GREATEST(-diff, 0)) {over(-13)} = 0 THEN 100
           ELSE 100 - 100 / (1 + SUM(GREATEST(diff, 0)) {over(-13)} / SUM(GREATEST(-diff, 0)) {over(-13)}) END AS rsi14,
         CASE WHEN prev > 0 THEN change / prev * 100 ELSE 0 END AS change_pct, MAX(close) {over(-251)} AS high_52w, MIN(close) {over(-251)} AS low_52w,
         volume / AVG(volume) {over(-20, -1)} AS vol_ratio FROM df),
       y AS (SELECT *, CASE WHEN close > s20 AND close > s50 THEN 'Uptrend' WHEN close < s20 AND close < s50 THEN 'Downtrend'
         WHEN s20 IS NOT NULL AND s50 IS NULL THEN CASE WHEN close > s20 THEN 'Uptrend' ELSE 'Downtrend' END ELSE 'Sideways' END AS trend
         FROM x QUALIFY d = MAX(d) OVER (PARTITION BY sym)),
       z AS (SELECT *, CASE WHEN rsi14 IS NULL THEN '-' WHEN rsi14 <= 30 AND trend = 'Uptrend' THEN 'Strong Buy'
         WHEN rsi14 <= 40 AND trend IN ('Uptrend', 'Sideways') THEN 'Buy' WHEN rsi14 >= 70 AND trend = 'Downtrend' THEN 'Strong Sell'
         WHEN rsi14 >= 65 AND trend = 'Downtrend' THEN 'Sell' WHEN trend = 'Uptrend' AND change_pct >= 0 THEN 'Accumulate'
         WHEN trend = 'Downtrend' AND change_pct < 0 THEN 'Caution' ELSE 'Neutral' END AS signal, close + 2.5 * atr AS take_profit, close - 1.5 * atr AS stop_loss FROM y),
       q AS (SELECT * FROM codes LEFT JOIN z USING (sym))""")
def _(t: Tables):
    return s.watchlist(t.bars(), _codes(t))


def _codes(t: Tables):
    """A request list: every supplier, and one unknown symbol."""
    k = F.col("s_suppkey")
    listed = t.table("supplier").select((k + 1).alias("pos"), F.concat(F.lit("S"), k.cast("string")).alias("sym"))
    return listed.unionByName(t.spark.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit("NONE").alias("sym")))


PORTFOLIO = B1 + f""", df AS (SELECT *, FIRST_VALUE(close) {over('-')} AS first_close FROM bars),
  held AS (SELECT sym, d, close, first_close AS buy_price, 100 AS quantity, first_close * 1.1 AS target,
    CASE WHEN prev > 0 THEN change / prev * 100 ELSE 0 END AS change_pct, (close / first_close - 1) * 100 AS pl_pct,
    (close - first_close) * 100 AS pl_nominal, (first_close * 1.1 - close) / close * 100 AS to_target_pct,
    CASE WHEN change > 0 THEN 'Buy' ELSE 'Sell' END AS signal FROM df QUALIFY d = MAX(d) OVER (PARTITION BY sym))"""


def _held(t: Tables):
    bars = t.bars()
    first = bars.groupBy("sym").agg(F.min_by("close", "d").alias("buy_price"))
    positions = first.select("sym", "buy_price", F.lit(100).alias("quantity"), (F.col("buy_price") * 1.1).alias("target"))
    current = latest(bars, per="sym").select(
        "sym", "d", "close", F.when(F.col("change") > 0, "Buy").otherwise("Sell").alias("signal"),
        F.when(F.col("prev") > 0, F.col("change") / F.col("prev") * 100).otherwise(0.0).alias("change_pct"))
    return s.portfolio(positions, current)


@query("portfolio_positions", "A16", "sym d:date pl_pct:6 pl_nominal:4 to_target_pct:6", PORTFOLIO + ", q AS (SELECT * FROM held)")
def _(t: Tables):
    return _held(t)


@query("portfolio_summary", "A16", "positions buys sells up down mean_change:5 pl_total:3",
       PORTFOLIO + """, q AS (SELECT COUNT(*) AS positions, COUNT(*) FILTER (WHERE signal = 'Buy') AS buys, COUNT(*) FILTER (WHERE signal = 'Sell') AS sells,
         COUNT(*) FILTER (WHERE change_pct > 0) AS up, COUNT(*) FILTER (WHERE change_pct < 0) AS down, AVG(change_pct) AS mean_change, SUM(pl_nominal) AS pl_total FROM held)""")
def _(t: Tables):
    return s.portfolio_summary(_held(t))


DAY_SQL = """COUNT(*) AS listed, COUNT(*) FILTER (WHERE volume > 0) AS active, COUNT(*) FILTER (WHERE change > 0) AS advancers,
  COUNT(*) FILTER (WHERE change < 0) AS decliners, COUNT(*) FILTER (WHERE COALESCE(change, 0) = 0) AS unchanged,
  COUNT(*) FILTER (WHERE COALESCE(change, 0) = 0 AND volume > 0) AS unchanged_active, COUNT(*) FILTER (WHERE volume <= 0) AS inactive,
  CAST(SUM(volume) AS BIGINT) AS volume, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, CAST(SUM(freq) AS BIGINT) AS freq,
  SUM(fbuy) AS fbuy, SUM(fsell) AS fsell, SUM(fbuy - fsell) AS net"""


@query("market_day_summary", "A1", "d:date listed active advancers decliners unchanged unchanged_active inactive volume value:2 freq fbuy:2 fsell:2 net:2",
       B2 + f", q AS (SELECT d, {DAY_SQL} FROM dense WHERE close > 0 GROUP BY d)")
def _(t: Tables):
    return m.market_day(t.dense_bars())


@query("market_breadth_history", "A2", "d:date advancers decliners breadth_pct:6 ad_line:int value:2 net:2",
       B2 + f""", day AS (SELECT d, {DAY_SQL} FROM dense WHERE close > 0 GROUP BY d ORDER BY d DESC LIMIT 252),
       q AS (SELECT *, advancers / GREATEST(advancers + decliners, 1) * 100 AS breadth_pct,
         SUM(advancers - decliners) OVER (ORDER BY d) - FIRST_VALUE(advancers - decliners) OVER (ORDER BY d) AS ad_line FROM day)""")
def _(t: Tables):
    return m.breadth(t.dense_bars(), 252)


@query("breadth_score", "A3", "d:date advance_pct:6 above20_pct:6 above50_pct:6 breadth_score:5 breadth_label median_return:6 new_high_20 new_low_20",
       T1 + """, per AS (SELECT d, COUNT(*) FILTER (WHERE change > 0) / GREATEST(COUNT(*) FILTER (WHERE volume > 0), 1) * 100 AS advance_pct,
         COUNT(*) FILTER (WHERE volume > 0 AND adj > sma20) / GREATEST(COUNT(*) FILTER (WHERE volume > 0 AND sma20 IS NOT NULL), 1) * 100 AS above20_pct,
         COUNT(*) FILTER (WHERE volume > 0 AND adj > sma50) / GREATEST(COUNT(*) FILTER (WHERE volume > 0 AND sma50 IS NOT NULL), 1) * 100 AS above50_pct,
         median(ret_1) FILTER (WHERE volume > 0) AS median_return, COUNT(*) FILTER (WHERE breakout_20) AS new_high_20, COUNT(*) FILTER (WHERE new_low_20) AS new_low_20
         FROM tech GROUP BY d),
       sc AS (SELECT *, advance_pct * 0.4 + above20_pct * 0.35 + above50_pct * 0.25 AS breadth_score FROM per),
       q AS (SELECT *, CASE WHEN breadth_score >= 65 THEN 'Strong' WHEN breadth_score >= 55 THEN 'Positive' WHEN breadth_score >= 45 THEN 'Neutral'
         WHEN breadth_score >= 35 THEN 'Weak' ELSE 'Very weak' END AS breadth_label FROM sc)""")
def _(t: Tables):
    # Score boundaries are compared after dropping the last bits, as 0.4, 0.35 and 0.25 are not exact.
    return m.breadth_score(s.technicals(t.bars()))


@query("market_movers", "X1", "list rank sym d:date ret_1:6 value:2",
       T1 + """, sc AS (SELECT *, avg_value_20 * 1e5 AS v FROM tech),
       r AS (SELECT 'gainer' AS list, sym, d, ret_1, value, ROW_NUMBER() OVER (PARTITION BY d ORDER BY ret_1 DESC NULLS LAST, sym) AS rank FROM sc WHERE v >= 1e9 AND volume > 0
         UNION ALL SELECT 'loser', sym, d, ret_1, value, ROW_NUMBER() OVER (PARTITION BY d ORDER BY ret_1 ASC NULLS LAST, sym) FROM sc WHERE v >= 1e9 AND volume > 0
         UNION ALL SELECT 'most_active', sym, d, ret_1, value, ROW_NUMBER() OVER (PARTITION BY d ORDER BY value DESC NULLS LAST, sym) FROM sc),
       q AS (SELECT * FROM r WHERE rank <= 8)""")
def _(t: Tables):
    tech = s.technicals(t.bars()).withColumn("avg_value_20", F.col("avg_value_20") * 1e5)
    return m.movers(tech)


@query("flow_rankings", "X2", "list rank sym d:date net:2 net_volume_pct:6 activity_score:6 flow_context",
       T1 + """, e AS (SELECT sym, d, ret_20 AS period_return, net_20d AS net, net_volume_pct_20 AS net_volume_pct, avg_value_20,
         CASE WHEN volume_ratio > 0 AND value_ratio > 0 AND freq_ratio > 0 THEN POW(volume_ratio * value_ratio * freq_ratio, 1.0 / 3) END AS activity_score,
         CASE WHEN COALESCE(ret_20, 0) >= 0 AND COALESCE(net_20d, 0) >= 0 THEN 'Price up + inflow' WHEN COALESCE(net_20d, 0) >= 0 THEN 'Price down + inflow'
           WHEN COALESCE(ret_20, 0) >= 0 THEN 'Price up + outflow' ELSE 'Price down + outflow' END AS flow_context FROM tech WHERE avg_value_20 >= 1e4),
       r AS (SELECT 'accumulation' AS list, *, ROW_NUMBER() OVER (PARTITION BY d ORDER BY net_volume_pct DESC, sym) AS rank FROM e WHERE net_volume_pct > 0
         UNION ALL SELECT 'distribution', *, ROW_NUMBER() OVER (PARTITION BY d ORDER BY net_volume_pct, sym) FROM e WHERE net_volume_pct < 0
         UNION ALL SELECT 'unusual_activity', *, ROW_NUMBER() OVER (PARTITION BY d ORDER BY activity_score DESC, sym) FROM e WHERE activity_score >= 1.2
         UNION ALL SELECT 'most_liquid', *, ROW_NUMBER() OVER (PARTITION BY d ORDER BY avg_value_20 DESC, sym) FROM e),
       q AS (SELECT * FROM r WHERE rank <= 10)""")
def _(t: Tables):
    return m.flow_rankings(s.technicals(t.bars()), 20, 10, min_value=1e4)


LOG_SQL = """log AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN COUNT(*) >= 4 THEN 'success' WHEN COUNT(*) >= 2 THEN 'no_data' ELSE 'failed' END AS status,
  COUNT(*) AS row_count, CASE WHEN COUNT(*) % 2 = 0 THEN 'x' END AS payload_sha256, CAST(o_orderdate AS DATE) AS updated_at FROM orders GROUP BY CAST(o_orderdate AS DATE))"""


def _log(t: Tables):
    """A sync log out of orders per day: many orders is a success, few a failure."""
    n = F.count(F.lit(1))
    return t.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(
        F.when(n >= 4, "success").when(n >= 2, "no_data").otherwise("failed").alias("status"), n.alias("row_count"),
        F.when(n % 2 == 0, "x").alias("payload_sha256")).withColumn("updated_at", F.col("d"))


@query("data_profile", "A4 J3", "total_rows date_from:date date_to:date trading_days tickers latest_rows active_pct:6 valid_open_pct:6 valid_high_low_pct:6 "
       "valid_foreign_pct:6 master_coverage_pct:6 success no_data failed hashed_pct:6 last_success:date last_attempt_status age_days:int freshness",
       B2 + f""", {MASTER}, {LOG_SQL}, known AS (SELECT sym FROM master WHERE board <> 'ASIA'),
       a AS (SELECT COUNT(*) AS total_rows, MIN(d) AS date_from, MAX(d) AS date_to, COUNT(DISTINCT d) AS trading_days, COUNT(DISTINCT sym) AS tickers FROM dense),
       b AS (SELECT COUNT(*) AS latest_rows, 100.0 * COUNT(*) FILTER (WHERE volume > 0) / COUNT(*) AS active_pct, 100.0 * COUNT(*) FILTER (WHERE open > 0) / COUNT(*) AS valid_open_pct,
         100.0 * COUNT(*) FILTER (WHERE high > 0 AND low > 0) / COUNT(*) AS valid_high_low_pct, 100.0 * COUNT(*) FILTER (WHERE fbuy IS NOT NULL AND fsell IS NOT NULL) / COUNT(*) AS valid_foreign_pct,
         100.0 * COUNT(*) FILTER (WHERE sym IN (SELECT sym FROM known)) / COUNT(*) AS master_coverage_pct FROM dense WHERE d = (SELECT MAX(d) FROM dense)),
       c AS (SELECT COUNT(*) FILTER (WHERE status = 'success') AS success, COUNT(*) FILTER (WHERE status = 'no_data') AS no_data, COUNT(*) FILTER (WHERE status = 'failed') AS failed,
         100.0 * COUNT(*) FILTER (WHERE status = 'success' AND payload_sha256 IS NOT NULL) / COUNT(*) FILTER (WHERE status = 'success') AS hashed_pct,
         MAX(d) FILTER (WHERE status = 'success') AS last_success, arg_max(status, updated_at) AS last_attempt_status FROM log),
       q AS (SELECT *, 5 AS age_days, 'check' AS freshness FROM a, b, c)""")
def _(t: Tables):
    bars = t.dense_bars()
    known = t.master().filter(F.col("board") != "ASIA")
    return m.profile(bars, known, _log(t), F.date_add(latest_date(bars), 5))


@query("symbols_outside_master", "J3", "sym",
       B2 + f", {MASTER}, q AS (SELECT sym FROM dense WHERE d = (SELECT MAX(d) FROM dense) AND sym NOT IN (SELECT sym FROM master WHERE board <> 'ASIA'))")
def _(t: Tables):
    return m.outside_master(t.dense_bars(), t.master().filter(F.col("board") != "ASIA"))


@query("quality_by_year", "A5", "year row_count symbols sessions null_open_pct:6 zero_volume_pct:6 bad_close",
       B2 + """, q AS (SELECT year(d) AS year, COUNT(*) AS row_count, COUNT(DISTINCT sym) AS symbols, COUNT(DISTINCT d) AS sessions,
         100.0 * COUNT(*) FILTER (WHERE open <= 0) / COUNT(*) AS null_open_pct, 100.0 * COUNT(*) FILTER (WHERE volume <= 0) / COUNT(*) AS zero_volume_pct,
         COUNT(*) FILTER (WHERE close IS NULL OR close <= 0) AS bad_close FROM dense GROUP BY year(d))""")
def _(t: Tables):
    return m.quality_by_year(t.dense_bars())


@query("recently_active_symbols", "A5", "active_symbols",
       B1 + ", q AS (SELECT COUNT(DISTINCT sym) AS active_symbols FROM bars WHERE d > (SELECT MAX(d) FROM bars) - 60 AND volume > 0)")
def _(t: Tables):
    return m.active_symbols(t.bars(windows=False))


@query("source_coverage", "A6", "date_from:date date_to:date dates keys row_count has_prev has_change loss_making",
       B1 + """, q AS (SELECT MIN(d) AS date_from, MAX(d) AS date_to, COUNT(DISTINCT d) AS dates, COUNT(DISTINCT sym) AS keys, COUNT(*) AS row_count,
         COUNT(prev) AS has_prev, COUNT(change) AS has_change, COUNT(*) FILTER (WHERE change < 0) AS loss_making FROM bars)""")
def _(t: Tables):
    return m.coverage(t.bars(), "d", ("prev", "change"), loss="change")


RANK_SQL = ("CASE WHEN {x} IS NOT NULL THEN (RANK() OVER (PARTITION BY d ORDER BY {x} NULLS LAST) + (COUNT(*) OVER (PARTITION BY d, {x}) - 1) / 2.0) "
            "/ COUNT({x}) OVER (PARTITION BY d) END AS {name}")


@query("cross_section_ranks", "X3", "sym d:date return_rank_1d:6 return_rank_5d:6 return_rank_20d:6 value_rank:6",
       B1 + f", r AS (SELECT *, " + ", ".join(f"close / LAG(close, {n}) {W} - 1 AS r{n}" for n in (1, 5, 20)) + " FROM bars), q AS (SELECT sym, d, " + ", ".join(
           RANK_SQL.format(x=f"r{n}", name=f"return_rank_{n}d") for n in (1, 5, 20)) + ", " + RANK_SQL.format(x="value", name="value_rank") + " FROM r)")
def _(t: Tables):
    return m.xs_ranks(t.bars())


MARKET_SQL = f"""mb AS (SELECT *, close / LAG(close) {W} - 1 AS pc, close / LAG(close, 5) {W} - 1 AS r5, {_sma_sql(20, 'close')} AS s20, {_sma_sql(50, 'close')} AS s50,
    CASE WHEN rn >= 20 THEN MAX(close) {over(-19)} END AS hi, CASE WHEN rn >= 20 THEN MIN(close) {over(-19)} END AS lo FROM bars),
  md AS (SELECT d, AVG(pc) AS ew, AVG(CAST(pc > 0 AS INT)) AS market_breadth_1d, AVG(CAST(close > s20 AS INT)) AS pct_above_sma20, AVG(CAST(close > s50 AS INT)) AS pct_above_sma50,
    AVG(CAST(r5 > 0 AS INT)) AS pct_stocks_up_5d, AVG(CAST(close >= hi AS INT)) AS new_highs_20d, AVG(CAST(close <= lo AS INT)) AS new_lows_20d,
    COUNT(*) FILTER (WHERE close >= hi) / (COUNT(*) FILTER (WHERE close <= lo) + 1) AS high_low_ratio, CASE WHEN COUNT(pc) > 5 THEN STDDEV_SAMP(pc) END AS market_dispersion,
    CASE WHEN COUNT(pc) > 0 THEN COUNT(*) FILTER (WHERE pc > 0) / (COUNT(*) FILTER (WHERE pc < 0) + 1) END AS advance_decline_ratio,
    CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS market_total_value, median(pc) AS market_median_return, ROW_NUMBER() OVER (ORDER BY d) AS k FROM mb GROUP BY d),
  me AS (SELECT *, {', '.join(f"CASE WHEN k > {n} THEN AVG(ew) OVER (ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS market_return_{n}d" for n in (1, 5, 20, 60))},
    CASE WHEN COUNT(ew) OVER (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN STDDEV_SAMP(ew) OVER (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * SQRT(252) END AS market_hvol20,
    CASE WHEN k >= 20 THEN market_total_value / (AVG(market_total_value) OVER (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + 1) END AS market_value_vs_ma20 FROM md),
  market AS (SELECT *, CASE WHEN market_hvol20 > 0.30 THEN 'HIGH_VOL' WHEN pct_above_sma20 IS NULL OR market_breadth_1d IS NULL THEN 'NEUTRAL'
    WHEN pct_above_sma20 > 0.60 AND market_return_20d > 0 THEN 'BULL_TREND' WHEN pct_above_sma20 > 0.45 THEN 'BULL_RANGE'
    WHEN pct_above_sma20 < 0.30 AND market_return_20d < 0 THEN 'BEAR_TREND' WHEN pct_above_sma20 < 0.45 THEN 'BEAR_RANGE' ELSE 'NEUTRAL' END AS market_regime FROM me)"""


@query("market_features", "X4", "d:date market_return_1d:6 market_return_5d:6 market_return_20d:6 market_return_60d:6 market_breadth_1d:6 pct_above_sma20:6 "
       "pct_above_sma50:6 pct_stocks_up_5d:6 new_highs_20d:6 new_lows_20d:6 high_low_ratio:6 market_dispersion:5 market_hvol20:5 advance_decline_ratio:6 "
       "market_median_return:6 market_total_value:2 market_value_vs_ma20:6",
       B1 + ", " + MARKET_SQL + ", q AS (SELECT * FROM market)")
def _(t: Tables):
    return m.market_features(t.bars())


# Prices with little of their noise on a yearly fall and rise, but for one wild year: every regime occurs.
CALM_SQL = B1.replace("\nbars AS (", "\nbars0 AS (") + """, bars AS (SELECT * REPLACE (CASE WHEN year(d) = 1996 THEN close
  ELSE close * 0.002 + 1000 * (1 + ABS(dayofyear(d) - 183)::DOUBLE / 183 * 0.3) END AS close) FROM bars0)"""


def _calm(bars):
    quiet = F.col("close") * 0.002 + 1000 * (1 + F.abs(F.dayofyear("d") - 183).cast("double") / 183 * 0.3)
    return bars.withColumn("close", F.when(F.year("d") == 1996, F.col("close")).otherwise(quiet))


@query("market_regime", "X5", "d:date market_regime regime_bullish:0 regime_bearish:0 regime_trending:0 regime_volatile:0",
       CALM_SQL + ", " + MARKET_SQL + """, q AS (SELECT d, market_regime, CAST(market_regime IN ('BULL_TREND', 'BULL_RANGE') AS INT) AS regime_bullish,
         CAST(market_regime IN ('BEAR_TREND', 'BEAR_RANGE') AS INT) AS regime_bearish, CAST(market_regime IN ('BULL_TREND', 'BEAR_TREND') AS INT) AS regime_trending,
         CAST(market_regime = 'HIGH_VOL' AS INT) AS regime_volatile FROM market)""")
def _(t: Tables):
    return m.market_features(_calm(t.bars()))


@query("sector_features", "X6", "sym d:date sector sector_return_5d:6 sector_rank:6 sector_n_stocks",
       B1 + f""", {MASTER}, r AS (SELECT *, close / LAG(close, 5) {W} - 1 AS r5 FROM bars),
       j AS (SELECT r.sym, r.d, r.r5, COALESCE(board, 'Unknown') AS sector FROM r LEFT JOIN master USING (sym)),
       sz AS (SELECT board AS sector, COUNT(DISTINCT sym) AS sector_n_stocks FROM master GROUP BY board),
       k AS (SELECT *, AVG(r5) OVER (PARTITION BY d, sector) AS sector_return_5d, CASE WHEN r5 IS NOT NULL AND COUNT(r5) OVER (PARTITION BY d, sector) > 1
         THEN (RANK() OVER (PARTITION BY d, sector ORDER BY r5 NULLS LAST) - 1) / COUNT(r5) OVER (PARTITION BY d, sector) END AS sector_rank FROM j),
       q AS (SELECT * FROM k LEFT JOIN sz USING (sector))""")
def _(t: Tables):
    return m.sector_features(t.bars(), t.master())


@query("data_signature", "signature helper", "newest:date rows_newest row_count",
       B1 + ", q AS (SELECT MAX(d) AS newest, COUNT(*) FILTER (WHERE d = (SELECT MAX(d) FROM bars)) AS rows_newest, COUNT(*) AS row_count FROM bars)")
def _(t: Tables):
    return s.signature(t.bars(windows=False))
