"""Queries over signals, universe, features and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dates import latest_date
from ..operators import features as ft
from ..operators import labels as lb
from ..operators import market as m
from ..operators import signals as sg
from ..operators import universe as un
from ..operators import windows as w
from ..session import work_path
from ..sources.trades import densify
from .base import B1, B2, B3, MASTER, REGISTRY, Tables, W, over, query
from .indicators import PC, SERIES, _macd_sql, _sma_sql, reduce_sql, seeded_sql


@query("signal_universe", "K10 J4", "rank sym n total_value:2",
       B3 + """, g AS (SELECT sym, COUNT(*) AS n, MAX(d) AS ld, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM bars GROUP BY sym),
       q AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total_value DESC, sym) AS rank FROM g WHERE n >= 260 AND ld = (SELECT MAX(d) FROM bars) QUALIFY rank <= 600)""")
def _(t: Tables):
    return sg.signal_universe(t.brand_bars())


def _liquid(t: Tables):
    """Brand bars with value scaled to the liquidity the rules expect."""
    return t.brand_bars().withColumn("value", F.col("value") * 1e5)


# SQL twin of the rule engine on the newest row of each brand: indicators, seven horizons, plan.
RULES_SQL = None


def _rules_sql() -> str:
    ind = f"""ob AS (SELECT *, SUM(mv) {over('-')} AS obv FROM (SELECT *, COALESCE(SIGN(close - LAG(close) {W}) * volume, 0) AS mv, fbuy - fsell AS net FROM bars)),
    ia AS (SELECT *, {', '.join(f"{_sma_sql(n, 'close')} AS sma{n}" for n in (5, 20, 50, 100, 200))}, CASE WHEN rn >= 20 THEN AVG(value * 1e5) {over(-19)} END AS avg_value,
      volume / AVG(volume) {over(-19)} AS vol_ratio, CASE WHEN rn >= 14 THEN CASE WHEN MAX(high) {over(-13)} = MIN(low) {over(-13)} THEN 50 ELSE 100 * (close - MIN(low) {over(-13)}) / (MAX(high) {over(-13)} - MIN(low) {over(-13)}) END END AS stoch_k,
      CASE WHEN rn >= 20 THEN STDDEV_POP(close) {over(-19)} END AS sd, COALESCE(LAG(obv, 5) {W}, 0) AS obv_before, SUM(net) {over(-4)} AS n5, SUM(net) {over(-19)} AS n20,
      CASE WHEN rn >= 60 THEN SUM(net) {over(-59)} END AS n60, CASE WHEN rn >= 10 THEN SUM(net) {over(-9, -5)} ELSE 0 END AS n5_before,
      {', '.join(f"COALESCE((close - LAG(close, {n}) {W}) / LAG(close, {n}) {W} * 100, 0) AS ret_{n}" for n in (1, 5, 20, 60, 250))},
      MAX(high) {over(-251)} AS high_52w, MIN(low) {over(-251)} AS low_52w FROM ob),
    ib AS (SELECT *, LAG(stoch_k) {W} AS stoch_k1, CASE WHEN rn >= 16 THEN AVG(stoch_k) {over(-2)} END AS stoch_d, sma20 + 2 * sd AS bb_upper, sma20 - 2 * sd AS bb_lower,
      (close - high_52w) / high_52w * 100 AS from_high FROM ia),
    ic AS (SELECT *, CASE WHEN bb_upper = bb_lower THEN 50 ELSE (close - bb_lower) / (bb_upper - bb_lower) * 100 END AS bb_pct FROM ib QUALIFY d = MAX(d) OVER (PARTITION BY sym)),
    {SERIES}, {_macd_sql(12, 26, 9, 'm')},
    rx AS (SELECT sym, list_last({seeded_sql('cs', 9, '(2.0::DOUBLE / 10)')}) AS ema9, list_last({seeded_sql('cs', 21, '(2.0::DOUBLE / 22)')}) AS ema21, list_last({seeded_sql('cs', 55, '(2.0::DOUBLE / 56)')}) AS ema55,
      list_last({seeded_sql('gs', 14, '(1.0::DOUBLE / 14)')}) AS ga, list_last({seeded_sql('ls', 14, '(1.0::DOUBLE / 14)')}) AS la, list_last({seeded_sql('trs[2:]', 14, '(1.0::DOUBLE / 14)')}) AS atr14,
      m_line[-1] AS macd_line, m_sig[-1] AS macd_signal, m_line[-1] - m_sig[-1] AS macd_hist, m_line[-2] - m_sig[-2] AS macd_hist_1 FROM mg),
    mv2 AS (SELECT *, LAG(close) {W} AS c1, high - LAG(high) {W} AS up, LAG(low) {W} - low AS dn FROM bars),
    dm AS (SELECT sym, list(GREATEST(high - low, ABS(high - c1), ABS(low - c1)) ORDER BY d) AS trs, list(CASE WHEN up > dn THEN GREATEST(up, 0) ELSE 0 END ORDER BY d) AS ps, list(CASE WHEN dn > up THEN GREATEST(dn, 0) ELSE 0 END ORDER BY d) AS mss FROM mv2 WHERE rn > 1 GROUP BY sym),
    ds AS (SELECT sym, {seeded_sql('trs', 14, '(1.0::DOUBLE / 14)')} AS t, {seeded_sql('ps', 14, '(1.0::DOUBLE / 14)')} AS p, {seeded_sql('mss', 14, '(1.0::DOUBLE / 14)')} AS m FROM dm),
    dx AS (SELECT sym, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] <> 0 AND p[i] + m[i] > 0 THEN ABS(p[i] - m[i]) / (p[i] + m[i]) * 100 ELSE 0 END) AS x FROM ds),
    ax AS (SELECT sym, list_last({seeded_sql('x', 14, '(1.0::DOUBLE / 14)')}) AS adx14 FROM dx),
    ind AS (SELECT ic.*, rx.* EXCLUDE (sym), CASE WHEN la <= 0 THEN 100 ELSE 100 - 100 / (1 + ga / la) END AS rsi14, adx14 FROM ic JOIN rx USING (sym) JOIN ax USING (sym) WHERE rn >= 260)"""
    trend = [(10, "close > sma200"), (8, "sma100 > sma200"), (8, "close > sma100"), (8, "close > sma50"), (8, "sma50 > sma100"), (6, "close > sma20"), (6, "sma20 > sma50"),
             (6, "ema9 > ema21"), (6, "ema21 > ema55"), (10, "macd_line > macd_signal"), (6, "macd_line > 0"), (8, "macd_hist > 0 AND macd_hist > macd_hist_1"), (8, "macd_hist_1 <= 0 AND macd_hist > 0")]
    parts = []
    for h, p in sg.HORIZONS.items():
        short, mid = h in ("1d", "1w"), h in ("1m", "3m")
        r = list(trend)
        r += [(12, "rsi14 BETWEEN 35 AND 55"), (8, "rsi14 < 40")] if short else [(12, "rsi14 BETWEEN 45 AND 65")] if mid else [(10, "rsi14 BETWEEN 40 AND 70")]
        r += [(6, "rsi14 > 50 AND ret_5 > 0"), (8, "stoch_k1 < 20 AND stoch_k > stoch_k1 AND stoch_k > stoch_d"), (6, "stoch_k BETWEEN 20 AND 80 AND stoch_k > stoch_d"), (8, "adx14 > 25"), (6, "adx14 > 35")]
        r += [(10, "close <= bb_lower * 1.02"), (6, "bb_pct < 20")] if short else []
        r += [(6, "close > sma20 AND bb_pct > 50")]
        r += [(10, "vol_ratio >= 1.5"), (6, "vol_ratio >= 1.2")] if short else [(8, "vol_ratio >= 1.2")] if mid else [(6, "vol_ratio >= 1.0")]
        r += [(6, "obv > obv_before")]
        r += {"1d": [(10, "n5 > 0"), (6, "n5 > n5_before"), (8, "ret_1 < -1.5 AND vol_ratio > 1.2"), (6, "ret_1 > -3 AND ret_1 < 0")],
              "1w": [(10, "n5 > 0"), (8, "n20 > 0"), (8, "ret_5 > -5 AND ret_5 < 2"), (6, "ret_5 > 0")], "1m": [(10, "n5 > 0"), (8, "n20 > 0"), (8, "ret_20 > 0")],
              "3m": [(8, "n20 > 0"), (10, "n60 > 0"), (8, "ret_60 > 0")], "6m": [(8, "n20 > 0"), (10, "n60 > 0"), (8, "ret_60 > 0")],
              "1y": [(10, "n60 > 0"), (10, "ret_250 > 0")], "gt1y": [(10, "n60 > 0"), (10, "ret_250 > 0")]}[h]
        r += [(6, "from_high < -10")] if mid else [] if short else [(8, "from_high > -40 AND from_high < -5")]
        total = sum(pts for pts, _ in r)
        pts = " + ".join(f"CASE WHEN {cond} THEN {p_} ELSE 0 END" for p_, cond in r)
        parts.append(f"SELECT *, '{h}' AS horizon, {pts} AS points, {total} AS possible, {p['mult']}::DOUBLE AS mult, {p['tp']}::DOUBLE AS tpm, {p['sl']}::DOUBLE AS slm, sma{p['sma']} AS support, {p['hold']}::DOUBLE AS hold FROM ind")
    return B3 + ", " + ind + ", hz AS (" + " UNION ALL ".join(parts) + """),
    sc AS (SELECT *, LEAST(round_even(CASE WHEN avg_value < 1e9 THEN points // 3 ELSE points END / possible * 100 * mult, 0), 100) AS score FROM hz),
    sl0 AS (SELECT *, CASE WHEN support < close THEN GREATEST(close - atr14 * slm, support * hold) ELSE close - atr14 * slm END AS st, high_52w - low_52w AS rng FROM sc WHERE score >= 40),
    sl1 AS (SELECT *, COALESCE((close + atr14 * tpm) * 0.7 + 0.3 * CASE WHEN high_52w + 0.272 * rng > close * 1.01 THEN high_52w + 0.272 * rng WHEN high_52w + 0.618 * rng > close * 1.01 THEN high_52w + 0.618 * rng END, close + atr14 * tpm) AS tg FROM sl0),
    sl2 AS (SELECT *, CASE WHEN close - st > 0 AND (tg - close) / (close - st) < 1.5 THEN close + (close - st) * 2 ELSE tg END AS tg2 FROM sl1),
    sl3 AS (SELECT *, CASE WHEN tg2 < 200 THEN 1 WHEN tg2 < 500 THEN 2 WHEN tg2 < 2000 THEN 5 WHEN tg2 < 5000 THEN 25 ELSE 50 END AS k1, CASE WHEN st < 200 THEN 1 WHEN st < 500 THEN 2 WHEN st < 2000 THEN 5 WHEN st < 5000 THEN 25 ELSE 50 END AS k2 FROM sl2),
    sl4 AS (SELECT *, CAST(round_even(tg2 / k1, 0) * k1 AS DOUBLE) AS tp, CAST(round_even(st / k2, 0) * k2 AS DOUBLE) AS sl FROM sl3),
    plan AS (SELECT *, ROUND((tp - close) / (close - sl), 2) AS rr_ratio, CASE WHEN score >= 78 THEN 'STRONG BUY' WHEN score >= 63 THEN 'BUY' WHEN score >= 50 THEN 'SPECULATIVE BUY' ELSE 'WATCH' END AS signal
      FROM sl4 WHERE tp > close AND sl < close AND ROUND((tp - close) / (close - sl), 2) >= 1.2)"""


PLAN_SQL = _rules_sql()
SIGNAL_SPEC = "horizon sym d:date score:int signal tp:0 sl:0 rr_ratio:2 close:4"


@query("signal_scores", "K7", "horizon sym score:int points:int possible:int", PLAN_SQL + ", q AS (SELECT * FROM sc WHERE score >= 40)")
def _(t: Tables):
    return sg.score(sg.indicators(_liquid(t)))


@query("signal_trade_plans", "K7 K8 P11 P12", SIGNAL_SPEC, PLAN_SQL + ", q AS (SELECT * FROM plan)")
def _(t: Tables):
    return sg.trade_plan(sg.score(sg.indicators(_liquid(t))))


@query("signal_ranking", "K7 K8 K9 X9", "rank trend foreign_flow volume_trend bb_place macd_state " + SIGNAL_SPEC,
       PLAN_SQL + """, x AS (SELECT *, CASE WHEN close > sma200 AND sma50 > sma100 AND sma100 > sma200 THEN 'strong uptrend' WHEN close > sma200 AND close > sma20 THEN 'uptrend'
         WHEN close < sma200 AND close < sma50 THEN 'downtrend' WHEN close < sma200 THEN 'below MA200' ELSE 'sideways' END AS trend,
         CASE WHEN n20 > 0 AND n5 > 0 THEN 'accumulation' WHEN n20 < 0 AND n5 < 0 THEN 'distribution' WHEN n5 > 0 THEN 'recent buying' ELSE 'neutral' END AS foreign_flow,
         CASE WHEN vol_ratio >= 1.5 THEN 'very high' WHEN vol_ratio >= 1.2 THEN 'high' WHEN vol_ratio < 0.6 THEN 'low' ELSE 'normal' END AS volume_trend,
         CASE WHEN bb_pct < 25 THEN 'near lower band' WHEN bb_pct > 75 THEN 'near upper band' ELSE 'middle' END AS bb_place, CASE WHEN macd_line > macd_signal THEN 'bullish' ELSE 'bearish' END AS macd_state FROM plan),
       q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY horizon ORDER BY score DESC, rr_ratio DESC, sym) AS rank FROM x WHERE d = (SELECT MAX(d) FROM bars) QUALIFY rank <= 20)""")
def _(t: Tables):
    bars = _liquid(t)
    return sg.signals(bars, 20, sg.signal_universe(bars))


MOVES = """mvs AS (SELECT dense.*, CASE WHEN prev > 0 THEN ABS((close - prev) / prev) END AS mv FROM dense)"""
STATUS = """CASE WHEN history_days < 120 THEN 'INSUFFICIENT_HISTORY' WHEN close_20 < 50 AND close_20 > 0 THEN 'PENNY_STOCK' WHEN days_since_active > 3 THEN 'SUSPENDED' WHEN zero_vol_ratio > {z} THEN 'SUSPENDED'
  WHEN pump_flag THEN 'GORENGAN_SUSPECTED' WHEN value_20 < 2e3 THEN 'LOW_LIQUIDITY' WHEN freq_20 < 0.1 THEN 'LOW_LIQUIDITY' WHEN has_action_warning THEN 'CORPORATE_ACTION_WARNING' ELSE 'ELIGIBLE' END"""
UNI_SPEC = "sym d:date status history_days close_20:4 value_20:3 freq_20:6 zero_vol_ratio:6 last_active:date days_since_active:int has_action_warning:int has_verified_action:int pump_flag:int on_watch_board:int"
WATCHED = MASTER + ", wb AS (SELECT sym, CASE WHEN board = 'ASIA' AND length(sym) = 3 THEN 'Watchlist' ELSE board END AS board FROM master)"
ACTIONS_SQL = f"""sh AS (SELECT *, CASE WHEN month(d) % 3 = 0 THEN 2 ELSE 1 END * shares AS shs FROM bars WHERE volume > 0),
  lg AS (SELECT *, CAST(shs AS DOUBLE) / LAG(shs) {W} AS sr, LAG(close) {W} / close AS pr FROM sh),
  ca AS (SELECT sym, d FROM lg WHERE ABS(sr - 1) > 0.05 AND ABS(sr - pr) / GREATEST(sr, pr) <= 0.25 AND ((sr > 1 AND pr > 1.02) OR (sr < 1 AND pr < 0.98)))"""


def _watched(t: Tables):
    return t.master().withColumn("board", F.when((F.col("board") == "ASIA") & (F.length("sym") == 3), "Watchlist").otherwise(F.col("board")))


def _quarterly_shares():
    return F.when(F.month("d") % 3 == 0, 2).otherwise(1) * F.col("shares")


def _universe_inputs(t: Tables):
    actions = w.corporate_actions(t.bars().withColumn("shares", _quarterly_shares()))
    return t.dense_bars(), _watched(t), actions


@query("universe_every_date", "U1 U2 D9", UNI_SPEC,
       B2 + f", {WATCHED}, {ACTIONS_SQL}, {MOVES}, " + """ev AS (SELECT m.*, CASE WHEN ca.d IS NOT NULL THEN 1 ELSE 0 END AS isca FROM mvs m LEFT JOIN ca ON ca.sym = m.sym AND ca.d = m.d),
       st AS (SELECT sym, d, rn AS history_days, AVG(close) OVER w20 AS close_20, AVG(value) OVER w20 AS value_20, AVG(freq) OVER w20 AS freq_20, AVG(CASE WHEN volume > 0 THEN 0 ELSE 1 END) OVER wa AS zero_vol_ratio,
         MAX(CASE WHEN volume > 0 AND close > 0 THEN d END) OVER wa AS last_active, SUM(CASE WHEN mv > 0.25 THEN 1 ELSE 0 END) OVER wr AS warn, SUM(CASE WHEN mv >= 0.20 THEN 1 ELSE 0 END) OVER wr AS ext, SUM(isca) OVER wr AS ver FROM ev
         WINDOW w20 AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), wa AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           wr AS (PARTITION BY sym ORDER BY d RANGE BETWEEN INTERVAL 120 DAYS PRECEDING AND CURRENT ROW)),
       fl AS (SELECT st.*, d - last_active AS days_since_active, warn > 0 OR ver > 0 AS has_action_warning, ver > 0 AS has_verified_action, board = 'Watchlist' AS on_watch_board,
         board = 'Watchlist' OR ext >= 4 AS pump_flag FROM st LEFT JOIN wb USING (sym)),
       q AS (SELECT *, """ + STATUS.format(z="0.20") + " AS status FROM fl)")
def _(t: Tables):
    bars = w.with_splits(t.bars().withColumn("_shares", _quarterly_shares()), "split", "_shares").drop("_shares")
    return un.universe_series(densify(bars, ("split",), t.bars(windows=False)), _watched(t), "split", min_value=2e3, min_freq=0.1)


@query("universe_as_of", "U1 J11", UNI_SPEC,
       B2 + f", {WATCHED}, {ACTIONS_SQL}, {MOVES}, pa AS (SELECT * FROM mvs WHERE d <= DATE '1999-06-30'), " + """
       a AS (SELECT sym, COUNT(*) AS history_days, AVG(CASE WHEN volume > 0 THEN 0 ELSE 1 END) AS zero_vol_ratio, MAX(d) FILTER (WHERE volume > 0) AS last_active,
         COUNT(*) FILTER (WHERE mv > 0.25 AND d >= DATE '1999-06-30' - 120) AS warn, COUNT(*) FILTER (WHERE mv >= 0.20 AND d >= DATE '1999-06-30' - 120) AS ext FROM pa GROUP BY sym),
       l AS (SELECT sym, AVG(close) AS close_20, AVG(value) AS value_20, AVG(freq) AS freq_20 FROM (SELECT * FROM pa QUALIFY ROW_NUMBER() OVER (PARTITION BY sym ORDER BY d DESC) <= 20) GROUP BY sym),
       fl AS (SELECT a.*, l.* EXCLUDE (sym), DATE '1999-06-30' AS d, DATE '1999-06-30' - last_active AS days_since_active, (SELECT COUNT(*) FROM ca WHERE ca.sym = a.sym AND ca.d BETWEEN DATE '1999-06-30' - 120 AND DATE '1999-06-30') > 0 AS has_verified_action,
         warn > 0 OR (SELECT COUNT(*) FROM ca WHERE ca.sym = a.sym AND ca.d BETWEEN DATE '1999-06-30' - 120 AND DATE '1999-06-30') > 0 AS has_action_warning,
         board = 'Watchlist' AS on_watch_board, board = 'Watchlist' OR ext >= 4 AS pump_flag FROM a LEFT JOIN l USING (sym) LEFT JOIN wb USING (sym)),
       q AS (SELECT *, """ + STATUS.format(z="0.20") + " AS status FROM fl)")
def _(t: Tables):
    bars, master, actions = _universe_inputs(t)
    return un.universe(bars, F.lit("1999-06-30").cast("date"), master, actions, min_value=2e3, min_freq=0.1)


@query("universe_of_active_brands", "U1 U2", "sym d:date status history_days:int value_20:3 pump_flag:int",
       B3 + """, typed AS (SELECT *, (CAST(substr(sym, 7) AS INT) - 1) // 5 + 1 AS a, (CAST(substr(sym, 7) AS INT) - 1) % 5 + 1 AS b FROM bars),
       fixed AS (SELECT * REPLACE (CASE WHEN a = 1 AND b = 2 THEN close * 0.02 ELSE close END AS close, CASE WHEN a >= 3 AND b = 2 THEN value * 0.01 ELSE value END AS value,
         CASE WHEN b = 5 AND rn % 3 = 0 THEN 0 ELSE volume END AS volume) FROM typed),
       mvs AS (SELECT *, CASE WHEN b = 3 AND rn % 300 = 0 THEN 0.28 WHEN b = 4 AND rn % 20 < a THEN 0.21 ELSE 0.1 END AS mv FROM fixed),
       st0 AS (SELECT sym, d, rn AS history_days, AVG(close) OVER w20 AS close_20, AVG(value) OVER w20 AS value_20, AVG(freq) OVER w20 AS freq_20,
         AVG(CASE WHEN volume > 0 THEN 0 ELSE 1 END) OVER wa AS zero_vol_ratio, MAX(CASE WHEN volume > 0 AND close > 0 THEN d END) OVER wa AS last_active,
         SUM(CASE WHEN mv > 0.25 THEN 1 ELSE 0 END) OVER wr > 0 AS has_action_warning, SUM(CASE WHEN mv >= 0.20 THEN 1 ELSE 0 END) OVER wr >= 4 AS pump_flag FROM mvs
         WINDOW w20 AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), wa AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           wr AS (PARTITION BY sym ORDER BY d RANGE BETWEEN INTERVAL 120 DAYS PRECEDING AND CURRENT ROW)),
       st AS (SELECT *, COALESCE(d - last_active, 9999) AS days_since_active FROM st0),
       q AS (SELECT *, """ + STATUS.format(z="0.20") + " AS status FROM st)")
def _(t: Tables):
    # Each brand is made to meet one rule of the ladder, by its number, on both sides.
    number = F.substring("sym", 7, 9).cast("int") - 1
    a, b = F.floor(number / 5) + 1, number % 5 + 1
    bars = w.with_rn(t.brand_bars())
    bars = bars.withColumns({
        "close": F.when((a == 1) & (b == 2), F.col("close") * 0.02).otherwise(F.col("close")),
        "value": F.when((a >= 3) & (b == 2), F.col("value") * 0.01).otherwise(F.col("value")),
        "volume": F.when((b == 5) & (F.col("rn") % 3 == 0), F.lit(0)).otherwise(F.col("volume"))})
    move = F.when((b == 3) & (F.col("rn") % 300 == 0), 0.28).when((b == 4) & (F.col("rn") % 20 < a), 0.21).otherwise(0.1)
    bars = bars.withColumn("prev", F.col("close") / (1 + move)).drop("rn")
    return un.universe_series(bars, min_value=2e3, min_freq=0.1)


@query("eligible_rows", "U2 J4", "d:date symbols",
       B3 + """, mvs AS (SELECT *, CASE WHEN prev > 0 THEN ABS((close - prev) / prev) END AS mv FROM bars),
       st AS (SELECT sym, d, rn, SUM(CASE WHEN mv >= 0.20 THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY d RANGE BETWEEN INTERVAL 120 DAYS PRECEDING AND CURRENT ROW) AS ext,
         AVG(value) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM mvs),
       q AS (SELECT d, COUNT(*) AS symbols FROM st WHERE rn >= 20 AND ext < 40 AND v >= 0 GROUP BY d)""")
def _(t: Tables):
    # Suppliers' prices jump on most days, so the flag for repeated jumps would drop every row here.
    states = un.universe_series(t.brand_bars(), min_history=20, min_value=0, min_freq=0, min_price=0, extreme_days=40)
    return un.eligible(states).groupBy("d").agg(F.count(F.lit(1)).alias("symbols"))


@query("training_rows", "U4", "sym d:date close:4", B2 + ", q AS (SELECT * FROM dense WHERE d >= DATE '1998-01-01' AND close > 0 AND volume > 0)")
def _(t: Tables):
    return un.training_bars(t.dense_bars(), F.lit("1998-01-01").cast("date"))


@query("training_quality_gate", "U4", "null_open:6 zero_volume:6 age_days:int verdict",
       B2 + ", q AS (SELECT COUNT(*) FILTER (WHERE open <= 0) / COUNT(*) AS null_open, COUNT(*) FILTER (WHERE volume <= 0) / COUNT(*) AS zero_volume, 3 AS age_days, 'fail' AS verdict FROM dense)")
def _(t: Tables):
    bars = t.dense_bars()
    return un.quality_gate(bars, F.date_add(latest_date(bars), 3))


@query("freshness_check", "U5", "newest:date age_days:int is_fresh:int", B1 + ", q AS (SELECT MAX(d) AS newest, 6 AS age_days, FALSE AS is_fresh FROM bars)")
def _(t: Tables):
    bars = t.bars()
    return un.freshness(bars, F.date_add(latest_date(bars), 6))


# ---- features ---------------------------------------------------------------------------------------

FEAT_NATIVE = ["return_1d:6", "return_60d:6", "log_return_5d:6", "up_streak:0", "close_vs_high_252d:6", "range_pct_120d:6", "gap_open:6", "body_pct:6", "close_location:6", "sma5:4", "sma200:4", "close_vs_sma100:6",
               "golden_cross:0", "sma20_slope:6", "efficiency_ratio_20d:6", "stoch_k:5", "williams_r:5", "roc10:6", "hvol60:6", "downside_vol5:6", "bb_width:6", "bb_squeeze:0", "rel_volume_60d:6", "avg_value_10d:3",
               "volume_today:0", "zero_vol_pct_20d:6", "mfi14:6", "amihud_20d:12", "foreign_net_20d:9", "foreign_buy_1d:9"]
FEAT_REC = ["ema5:4", "ema100:4", "close_vs_ema20:6", "rsi14:5", "rsi2:4", "atr14:4", "atr20_pct:6", "macd_line:6", "macd_signal:6", "macd_bullish:0", "ma_aligned_bull:0"]


def _cs(n: int, kind: str) -> str:
    return f"{kind}(close) {over(1 - n)}"


FEAT_SQL = B3 + f""", {PC}, p1 AS (SELECT *, close - LAG(close) {W} AS diff, (high + low + close) / 3 AS tp, SIGN(close - LAG(close) {W}) AS sg, ABS(pc) / (value + 1) AS am FROM pcs),
  p2 AS (SELECT *, CASE WHEN tp > LAG(tp) {W} THEN tp * volume ELSE 0 END AS upf, CASE WHEN tp < LAG(tp) {W} THEN tp * volume ELSE 0 END AS dnf, {_sma_sql(20, 'close')} AS s20,
    CASE WHEN rn >= 20 THEN STDDEV_SAMP(close) {over(-19)} END AS sd, CASE WHEN sg = LAG(sg) {W} THEN 0 ELSE 1 END AS brk FROM (SELECT * FROM p1)),
  p3 AS (SELECT *, SUM(brk) {over('-')} AS isl, 4 * sd / s20 AS bb_width FROM p2),
  native AS (SELECT *, close / LAG(close) {W} - 1 AS return_1d, close / LAG(close, 60) {W} - 1 AS return_60d, LN(close / LAG(close, 5) {W}) AS log_return_5d,
    CASE WHEN sg > 0 THEN ROW_NUMBER() OVER (PARTITION BY sym, isl ORDER BY d) ELSE 0 END AS up_streak, CASE WHEN rn > 252 THEN close / {_cs(252, 'MAX')} - 1 END AS close_vs_high_252d,
    CASE WHEN rn > 120 THEN {_cs(120, 'MAX')} / {_cs(120, 'MIN')} - 1 END AS range_pct_120d, open / LAG(close) {W} - 1 AS gap_open, CASE WHEN high > low THEN ABS(close - open) / (high - low) END AS body_pct,
    CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_location, {_sma_sql(5, 'close')} AS sma5, {_sma_sql(200, 'close')} AS sma200, close / ({_sma_sql(100, 'close')}) - 1 AS close_vs_sma100,
    CASE WHEN rn >= 200 THEN CASE WHEN AVG(close) {over(-49)} > AVG(close) {over(-199)} THEN 1 ELSE 0 END END AS golden_cross, s20 / LAG(s20, 5) {W} - 1 AS sma20_slope,
    CASE WHEN rn >= 21 THEN ABS(close - LAG(close, 20) {W}) / SUM(ABS(diff)) {over(-19)} END AS efficiency_ratio_20d,
    CASE WHEN rn >= 14 THEN 100 * (close - MIN(low) {over(-13)}) / (MAX(high) {over(-13)} - MIN(low) {over(-13)} + 1e-10) END AS stoch_k,
    CASE WHEN rn >= 14 THEN -100 * (MAX(high) {over(-13)} - close) / (MAX(high) {over(-13)} - MIN(low) {over(-13)} + 1e-10) END AS williams_r, close / LAG(close, 10) {W} - 1 AS roc10,
    CASE WHEN rn > 60 THEN STDDEV_SAMP(pc) {over(-59)} * SQRT(252) END AS hvol60, CASE WHEN rn > 5 THEN STDDEV_SAMP(CASE WHEN pc < 0 THEN pc ELSE 0 END) {over(-4)} * SQRT(252) END AS downside_vol5,
    CASE WHEN rn < 25 THEN NULL WHEN rn >= 39 AND bb_width <= 1.1 * MIN(bb_width) {over(-19)} THEN 1 ELSE 0 END AS bb_squeeze, CASE WHEN rn > 60 THEN volume / (AVG(volume) {over(-59)} + 1e-10) END AS rel_volume_60d,
    CASE WHEN rn > 10 THEN AVG(value) {over(-9)} END AS avg_value_10d, volume AS volume_today, CASE WHEN rn >= 20 THEN 0.0 END AS zero_vol_pct_20d,
    CASE WHEN rn >= 14 THEN 100 - 100 / (1 + SUM(upf) {over(-13)} / (SUM(dnf) {over(-13)} + 1e-10)) END AS mfi14, CASE WHEN rn >= 20 THEN AVG(am) {over(-19)} END AS amihud_20d,
    CASE WHEN rn >= 20 AND SUM(fbuy) {over('-')} > 0 THEN SUM(fbuy - fsell) {over(-19)} / (SUM(value) {over(-19)} + 1) ELSE 0 END AS foreign_net_20d,
    CASE WHEN SUM(fbuy) {over('-')} > 0 THEN fbuy / (value + 1) ELSE 0 END AS foreign_buy_1d FROM p3)"""


@query("feature_vector_native", "U3 W25 W26 W27 W28 W29 W34", "sym d:date " + " ".join(FEAT_NATIVE), FEAT_SQL + ", q AS (SELECT * FROM native WHERE rn >= 5)")
def _(t: Tables):
    return ft.features(t.brand_bars())


@query("feature_vector_recursive", "U3 W7 W9 W10 W13 W29", "sym d:date " + " ".join(FEAT_REC),
       B3 + f""", {SERIES}, e AS (SELECT *, {', '.join(f"{reduce_sql('cs', f'(2.0::DOUBLE / {n + 1})')} AS e{n}" for n in (5, 12, 20, 26, 50, 100))},
         {', '.join(f"{reduce_sql(x, f'(1.0::DOUBLE / {n})')} AS {x}{n}" for n in (2, 14) for x in ('gs', 'ls'))}, {reduce_sql('trs', '(1.0::DOUBLE / 14)')} AS t14, {reduce_sql('trs', '(1.0::DOUBLE / 20)')} AS t20 FROM series),
       ml AS (SELECT *, list_transform(range(26, n + 1), lambda i: e12[i] - e26[i]) AS line FROM e), mz AS (SELECT *, {reduce_sql('line', '(2.0::DOUBLE / 10)')} AS sig FROM ml),
       u AS (SELECT *, UNNEST(ds) AS d, UNNEST(cs) AS c, UNNEST(range(1, n + 1)) AS i FROM mz),
       q AS (SELECT sym, d, e5[i] AS ema5, CASE WHEN i >= 100 THEN e100[i] END AS ema100, CASE WHEN i >= 20 THEN c / e20[i] - 1 END AS close_vs_ema20,
         CASE WHEN i >= 15 AND ls14[i - 1] <> 0 THEN 100 - 100 / (1 + gs14[i - 1] / ls14[i - 1]) END AS rsi14, CASE WHEN ls2[i - 1] <> 0 THEN 100 - 100 / (1 + gs2[i - 1] / ls2[i - 1]) END AS rsi2,
         CASE WHEN i >= 14 THEN t14[i] END AS atr14, CASE WHEN i >= 20 THEN t20[i] / c END AS atr20_pct, CASE WHEN i >= 26 THEN line[i - 25] / c END AS macd_line, CASE WHEN i >= 34 THEN sig[i - 25] / c END AS macd_signal,
         CASE WHEN i >= 26 THEN CASE WHEN i >= 34 AND line[i - 25] > sig[i - 25] THEN 1 ELSE 0 END END AS macd_bullish,
         CASE WHEN i >= 100 THEN CASE WHEN c > e20[i] AND e20[i] > e50[i] AND e50[i] > e100[i] THEN 1 ELSE 0 END END AS ma_aligned_bull FROM u WHERE i >= 5)""")
def _(t: Tables):
    return ft.features(t.brand_bars())


@query("features_all_columns", "U3", "sym d:date " + " ".join(f"{n}:6" for n in ft.feature_names()))
def _(t: Tables):
    return ft.features(t.bars())


# ---- labels --------------------------------------------------------------------------------------------

LABEL_SPEC = ("sym d:date current_close:4 has_labels:int is_inference:int entry_price:4 exit_price:4 trade_return:6 label:int future_return_1d:6 future_return_3d:6 "
              "future_return_5d:6 future_return_10d:6 mfe:6 mae:6 tp_sl_success:int days_to_tp:int")


def _labels_sql(base: str, src: str) -> str:
    cal = "" if src == "dense" else ", cal AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS s FROM (SELECT DISTINCT d FROM bars))"
    rows = "lb AS (SELECT * FROM dense)" if src == "dense" else "lb AS (SELECT bars.*, s FROM bars JOIN cal USING (d))"
    fut = ", ".join(f"f{k}.close AS c{k}, f{k}.high AS h{k}, f{k}.low AS l{k}" for k in (1, 2, 3, 4, 5)) + ", f10.close AS c10, f1.open AS o1"
    joins = " ".join(f"LEFT JOIN lb f{k} ON f{k}.sym = a.sym AND f{k}.s = a.s + {k}" for k in (1, 2, 3, 4, 5, 10))
    return base + cal + f""", {rows}, fw AS (SELECT a.*, {fut} FROM lb a {joins}),
      en AS (SELECT *, CASE WHEN o1 > 0 THEN o1 ELSE close END AS entry, s + 5 <= (SELECT MAX(s) FROM lb) AS has_labels FROM fw WHERE close > 0),
      ou AS (SELECT *, c5 / entry - 1 AS ret, {'COALESCE(' + ', '.join(f'CASE WHEN h{k} >= entry * (1 + 0.03::DOUBLE) THEN {k} END' for k in range(1, 6)) + ')'} AS tpd,
        {'COALESCE(' + ', '.join(f'CASE WHEN l{k} <= entry * (1 - 0.02::DOUBLE) THEN {k} END' for k in range(1, 6)) + ')'} AS sld,
        GREATEST(0, {', '.join(f'CASE WHEN h{k} > 0 THEN h{k} / entry - 1 END' for k in range(1, 6))}) AS up, LEAST(0, {', '.join(f'CASE WHEN l{k} > 0 THEN l{k} / entry - 1 END' for k in range(1, 6))}) AS dn
        FROM en WHERE NOT has_labels OR c5 > 0),
      q AS (SELECT sym, d, close AS current_close, has_labels, NOT has_labels AS is_inference, CASE WHEN has_labels THEN entry END AS entry_price, CASE WHEN has_labels THEN c5 END AS exit_price,
        CASE WHEN has_labels THEN ret END AS trade_return, CASE WHEN has_labels THEN CASE WHEN ret >= 0.02 THEN 1 ELSE 0 END END AS label,
        {', '.join(f'CASE WHEN has_labels AND c{k} > 0 THEN c{k} / close - 1 END AS future_return_{k}d' for k in (1, 3, 5, 10))}, CASE WHEN has_labels THEN up END AS mfe, CASE WHEN has_labels THEN dn END AS mae,
        CASE WHEN NOT has_labels THEN NULL WHEN tpd IS NOT NULL AND sld IS NULL THEN 1 WHEN sld IS NOT NULL AND tpd IS NULL THEN 0 WHEN tpd < sld THEN 1 WHEN sld <= tpd THEN 0 WHEN ret >= 0 THEN 1 ELSE 0 END AS tp_sl_success,
        CASE WHEN has_labels AND tpd IS NOT NULL AND (sld IS NULL OR tpd < sld) THEN tpd END AS days_to_tp FROM ou)"""


@query("forward_labels_dense", "L1", LABEL_SPEC, _labels_sql(B2, "dense"))
def _(t: Tables):
    return lb.labels(t.dense_bars())


@query("forward_labels_sparse", "L1", LABEL_SPEC, _labels_sql(B3, "bars"))
def _(t: Tables):
    return lb.labels(t.brand_bars())


FAST_SQL = f"""ff AS (SELECT *, LEAD(close, 5) {W} AS exit_price, MAX(high) {over(1, 5)} AS hi, MIN(low) {over(1, 5)} AS lo FROM bars),
  fl AS (SELECT sym, d, close AS entry_price, exit_price, (exit_price - close) / close AS trade_return, (hi - close) / close >= 0.05 AS tp, (lo - close) / close <= -0.02 AS sl FROM ff WHERE exit_price IS NOT NULL),
  fast AS (SELECT *, CASE WHEN tp AND sl THEN CASE WHEN trade_return > 0 THEN 1 ELSE 0 END WHEN tp THEN 1 WHEN sl THEN 0 WHEN trade_return >= 0.02 THEN 1 ELSE 0 END AS label FROM fl)"""


@query("training_labels", "L2 D1", "sym d:date entry_price:4 exit_price:4 trade_return:6 label:int", B1 + f", {FAST_SQL}, q AS (SELECT * FROM fast)")
def _(t: Tables):
    return lb.labels_fast(t.bars())


@query("training_dataset", "L4 J12 U3 X3 X4 D19", "sym d:date close:4 return_5d:6 label:int trade_return:6 market_regime return_rank_5d:6",
       B3 + f""", {FAST_SQL}, r AS (SELECT *, close / LAG(close, 5) {W} - 1 AS r5 FROM bars), rk AS (SELECT *, CASE WHEN r5 IS NOT NULL THEN (RANK() OVER (PARTITION BY d ORDER BY r5 NULLS LAST) + (COUNT(*) OVER (PARTITION BY d, r5) - 1) / 2.0) / COUNT(r5) OVER (PARTITION BY d) END AS return_rank_5d FROM r),
       c AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS s FROM (SELECT DISTINCT d FROM bars WHERE rn >= 5)), """ + __import__("sparkbars.plans.screens", fromlist=["MARKET_SQL"]).MARKET_SQL + """,
       q AS (SELECT rk.sym, rk.d, rk.close, r5 AS return_5d, fast.label, fast.trade_return, market_regime, return_rank_5d FROM rk JOIN fast ON fast.sym = rk.sym AND fast.d = rk.d JOIN c ON c.d = rk.d AND (c.s - 1) % 5 = 0
         LEFT JOIN market ON market.d = rk.d WHERE rk.rn >= 5)""")
def _(t: Tables):
    bars = t.brand_bars()
    market = m.market_features(bars).select("d", "market_regime", "market_breadth_1d", "market_hvol20")
    ranks = m.xs_ranks(bars).select("sym", "d", "return_rank_5d", "value_rank")
    return lb.dataset(ft.features(bars), lb.labels_fast(bars), market=market, ranks=ranks, every=5)


@query("stored_training_dataset", "L4 L5 U3", "sym d:date close:4 return_5d:6 label:int trade_return:6 market_regime return_rank_5d:6", REGISTRY["training_dataset"].ctes)
def _(t: Tables):
    """The same rows from bucketed tables: only numeric features are stored, identifiers and outcomes apart from them."""
    bars = t.brand_bars()
    features = ft.features(bars)
    name = f"training_{uuid.uuid4().hex}"
    lb.store_training(name, 8, features.select("sym", "d", "close", *ft.feature_cols(features)), lb.labels_fast(bars), ranks=m.xs_ranks(bars).select("sym", "d", "return_rank_5d", "value_rank"),
                      path=work_path(t.spark, name))
    market = m.market_features(bars).select("d", "market_regime", "market_breadth_1d", "market_hvol20")
    return lb.stored_dataset(t.spark, name, market, every=5)
