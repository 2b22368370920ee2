"""Queries over the per-symbol window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prices import depth_imbalance, spread_pct
from ..operators import windows as w
from ..operators.recurrences import with_recurrences
from .base import B1, B3, W, over, query

# Shared SQL: back-adjusted prices in backward form (product of all later gaps).
GAPS = """gaps AS (SELECT *, LAG(close) OVER (PARTITION BY sym ORDER BY d) AS c1,
  CASE WHEN COALESCE(prev, 0) > 0 THEN prev ELSE LAG(close) OVER (PARTITION BY sym ORDER BY d) END AS ref FROM bars),
facs AS (SELECT *, CASE WHEN c1 > 0 AND ref > 0 THEN ref / c1 ELSE 1.0 END AS gap FROM gaps),
scaled AS (SELECT *, COALESCE(PRODUCT(gap) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS scale FROM facs),
adjusted AS (SELECT *, close * scale AS adj, high * scale AS adj_high, low * scale AS adj_low, open * scale AS adj_open FROM scaled)"""
ADJ = B1 + ",\n" + GAPS


@query("back_adjusted_bars", "W1", "sym d:date close:4 adj:4 adj_high:4 adj_low:4 adj_open:4",
       ADJ + ", q AS (SELECT * FROM adjusted)")
def _(t):
    return w.back_adjust(t.bars())


@query("reference_gap_events", "W2", "sym d:date c1:4 ref:4 gap_pct:6",
       ADJ + ", q AS (SELECT *, (ref / c1 - 1) * 100 AS gap_pct FROM facs WHERE ref > 0 AND c1 > 0 AND ABS(ref / c1 - 1) >= 0.05)")
def _(t):
    return w.gap_events(t.bars())


@query("reference_gap_summary", "W2", "sym events last_dates:arr",
       ADJ + """, ev AS (SELECT sym, d, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY d DESC) AS k FROM facs
         WHERE ref > 0 AND c1 > 0 AND ABS(ref / c1 - 1) >= 0.05),
       q AS (SELECT sym, COUNT(*) AS events, list(CAST(d AS VARCHAR) ORDER BY d) FILTER (WHERE k <= 5) AS last_dates FROM ev GROUP BY sym)""")
def _(t):
    return w.gap_summary(t.bars())


@query("session_returns", "W3", "sym d:date ret_1:6 ret_5:6 ret_20:6 ret_60:6",
       ADJ + ", q AS (SELECT sym, d, " + ", ".join(
           f"CASE WHEN LAG(adj, {n}) {W} > 0 THEN (adj / LAG(adj, {n}) {W} - 1) * 100 END AS ret_{n}"
           for n in (1, 5, 20, 60)) + " FROM adjusted)")
def _(t):
    return w.returns(w.back_adjust(t.bars()))


def _sma_sql(n: int, x: str = "adj") -> str:
    return f"CASE WHEN rn >= {n} THEN AVG({x}) {over(1 - n)} END"


@query("sma_distance", "W4", "sym d:date sma20:4 sma50:4 sma200:4 dist_sma20:6 dist_sma50:6 dist_sma200:6",
       ADJ + ", q AS (SELECT sym, d, " + ", ".join(
           f"{_sma_sql(n)} AS sma{n}, (adj / {_sma_sql(n)} - 1) * 100 AS dist_sma{n}" for n in (20, 50, 200))
       + " FROM adjusted)")
def _(t):
    return w.with_sma(w.back_adjust(t.bars()))


RSI_CUTLER_SQL = f"""CASE WHEN rn < 15 THEN NULL
  WHEN SUM(GREATEST(diff, 0)) {over(-13)} = 0 AND SUM(GREATEST(-diff, 0)) {over(-13)} = 0 THEN 50
  WHEN SUM(GREATEST(-diff, 0)) {over(-13)} = 0 THEN 100
  ELSE 100 - 100 / (1 + (SUM(GREATEST(diff, 0)) {over(-13)} / 14) / (SUM(GREATEST(-diff, 0)) {over(-13)} / 14)) END"""
DIFFS = f"diffs AS (SELECT *, adj - LAG(adj) {W} AS diff FROM adjusted)"


@query("rsi_simple_mean", "W5", "sym d:date rsi14:6",
       ADJ + f", {DIFFS}, q AS (SELECT sym, d, {RSI_CUTLER_SQL} AS rsi14 FROM diffs)")
def _(t):
    return w.with_diff(w.back_adjust(t.bars())).withColumn("rsi14", w.rsi_cutler(14))


@query("atr_percent", "W11", "sym d:date atr14_pct:6",
       ADJ + f""", tr1 AS (SELECT *, CASE WHEN ref > 0 THEN GREATEST(high - low, ABS(high - ref), ABS(low - ref)) / ref * 100 END AS trp FROM gaps),
       q AS (SELECT sym, d, CASE WHEN COUNT(trp) {over(-13)} = 14 THEN AVG(trp) {over(-13)} END AS atr14_pct FROM tr1)""")
def _(t):
    return w.atr_pct(t.bars())


@query("atr_close_to_close", "W14", "sym d:date atr:4",
       ADJ + f", {DIFFS}, q AS (SELECT sym, d, AVG(ABS(diff)) {over(-13)} AS atr FROM diffs)")
def _(t):
    return w.with_diff(w.back_adjust(t.bars())).withColumn("atr", w.atr_close(14))


@query("log_volatility", "W15", "sym d:date volatility20:6",
       ADJ + f""", lr AS (SELECT *, LN(adj / LAG(adj) {W}) AS lr FROM adjusted),
       q AS (SELECT sym, d, CASE WHEN rn >= 21 THEN STDDEV_POP(lr) {over(-19)} * SQRT(252) * 100 END AS volatility20 FROM lr)""")
def _(t):
    return w.vol_log(w.back_adjust(t.bars()))


PC = f"pcs AS (SELECT *, close / LAG(close) {W} - 1 AS pc FROM bars)"


@query("sample_volatility", "W16", "sym d:date hvol20:6 hvol60:6 downside_vol20:6 hvol_pctile:6",
       B1 + f""", {PC}, hv AS (SELECT sym, d, rn,
         CASE WHEN rn > 20 THEN STDDEV_SAMP(pc) {over(-19)} * SQRT(252) END AS hvol20,
         CASE WHEN rn > 60 THEN STDDEV_SAMP(pc) {over(-59)} * SQRT(252) END AS hvol60,
         CASE WHEN rn > 20 THEN STDDEV_SAMP(CASE WHEN pc < 0 THEN pc ELSE 0 END) {over(-19)} * SQRT(252) END AS downside_vol20 FROM pcs),
       seen AS (SELECT *, list(hvol20) FILTER (WHERE hvol20 IS NOT NULL) {over(-59)} AS seen FROM hv),
       q AS (SELECT *, CASE WHEN rn >= 60 AND len(seen) >= 10 THEN len(list_filter(seen, lambda v: v <= hvol20)) / len(seen) END AS hvol_pctile FROM seen)""")
def _(t):
    df = w.with_hvols(w.with_pct_change(w.with_rn(t.bars())), 20, 3)
    return w.hvol_percentile(df.withColumn("downside_vol20", w.downside_vol(20)))


@query("max_drawdown_60", "W17", "sym d:date mdd:6",
       ADJ + f""", win AS (SELECT sym, d, rn, list(adj) {over(-59)} AS xs FROM adjusted),
       q AS (SELECT sym, d, CASE WHEN rn >= 2 THEN 100 * list_min(list_transform(range(1, len(xs) + 1),
         lambda i: xs[i] / list_max(xs[1:i]) - 1)) END AS mdd FROM win)""")
def _(t):
    return w.with_max_drawdown(w.back_adjust(t.bars()), "mdd", 60)


@query("drawdown_from_high", "W18", "sym d:date drawdown:6",
       B3 + f", q AS (SELECT sym, d, (close / MAX(close) {over('-')} - 1) * 100 AS drawdown FROM bars)")
def _(t):
    return t.brand_bars().withColumn("drawdown", w.drawdown_ath())


def _bollinger_sql(dev: str) -> str:
    return B1 + f""", b0 AS (SELECT *, {_sma_sql(20, 'close')} AS bb_mid, CASE WHEN rn >= 20 THEN {dev}(close) {over(-19)} END AS sd FROM bars),
       b1 AS (SELECT *, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower, 4 * sd / bb_mid AS bb_width FROM b0),
       q AS (SELECT *, CASE WHEN bb_mid IS NULL THEN NULL WHEN bb_upper = bb_lower THEN 50 ELSE (close - bb_lower) / (bb_upper - bb_lower) * 100 END AS bb_pct,
         (close - bb_lower) / (bb_upper - bb_lower + 1e-10) AS bb_position,
         CASE WHEN rn < 25 THEN NULL WHEN rn >= 39 AND bb_width <= 1.1 * MIN(bb_width) {over(-19)} THEN 1 ELSE 0 END AS bb_squeeze FROM b1)"""


BB_SPEC = "sym d:date bb_mid:4 bb_upper:4 bb_lower:4 bb_width:6 bb_pct:5 bb_position:6 bb_squeeze:0"


@query("bollinger_population", "W19", BB_SPEC, _bollinger_sql("STDDEV_POP"))
def _(t):
    return w.bollinger(t.bars(), ddof=0)


@query("bollinger_sample", "W19", BB_SPEC, _bollinger_sql("STDDEV_SAMP"))
def _(t):
    return w.bollinger(t.bars(), ddof=1)


HI14, LO14 = f"MAX(high) {over(-13)}", f"MIN(low) {over(-13)}"


@query("stochastic", "W20", "sym d:date stoch_k:5 stoch_d:5 eps_k:5 null_k:5",
       B1 + f""", k AS (SELECT *, CASE WHEN rn < 14 THEN NULL WHEN {HI14} = {LO14} THEN 50 ELSE 100 * (close - {LO14}) / ({HI14} - {LO14}) END AS stoch_k,
         CASE WHEN rn >= 14 THEN 100 * (close - {LO14}) / ({HI14} - {LO14} + 1e-10) END AS eps_k,
         CASE WHEN rn >= 14 AND {HI14} <> {LO14} THEN 100 * (close - {LO14}) / ({HI14} - {LO14}) END AS null_k FROM bars),
       q AS (SELECT *, CASE WHEN rn >= 16 THEN AVG(stoch_k) {over(-2)} END AS stoch_d FROM k)""")
def _(t):
    df = w.stoch(t.bars(), flat="epsilon").withColumnRenamed("stoch_k", "eps_k").drop("stoch_d")
    df = w.stoch(df, flat="null").withColumnRenamed("stoch_k", "null_k").drop("stoch_d")
    return w.stoch(df)


@query("williams_r", "W21", "sym d:date williams:5",
       B1 + f", q AS (SELECT sym, d, CASE WHEN rn >= 14 THEN -100 * ({HI14} - close) / ({HI14} - {LO14} + 1e-10) END AS williams FROM bars)")
def _(t):
    return w.with_rn(t.bars()).withColumn("williams", w.williams_r())


@query("on_balance_volume", "W23", "sym d:date obv:2 obv_ma20:4 obv_vs_ma20:6",
       B1 + f""", m AS (SELECT *, COALESCE(SIGN(close - LAG(close) {W}) * volume, 0) AS mv FROM bars),
       o AS (SELECT *, SUM(mv) {over('-')} AS obv FROM m),
       o2 AS (SELECT *, CASE WHEN rn >= 21 THEN AVG(obv) {over(-19)} END AS obv_ma20 FROM o),
       q AS (SELECT *, (obv - obv_ma20) / (ABS(obv_ma20) + 1e-10) AS obv_vs_ma20 FROM o2 WHERE COALESCE(ABS(obv_ma20), 1) > 1e-6)""")
def _(t):
    return w.obv(t.bars()).filter(F.coalesce(F.abs("obv_ma20"), F.lit(1.0)) > 1e-6)


@query("money_flow_index", "W24", "sym d:date mfi14:6",
       B1 + f""", p AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
       p2 AS (SELECT *, CASE WHEN tp > LAG(tp) {W} THEN tp * volume ELSE 0 END AS up,
         CASE WHEN tp < LAG(tp) {W} THEN tp * volume ELSE 0 END AS dn FROM p),
       q AS (SELECT sym, d, CASE WHEN rn >= 14 THEN 100 - 100 / (1 + SUM(up) {over(-13)} / (SUM(dn) {over(-13)} + 1e-10)) END AS mfi14 FROM p2)""")
def _(t):
    return w.mfi(t.bars())


@query("rate_of_change_efficiency", "W25", "sym d:date roc10:6 efficiency20:6",
       B1 + f""", df AS (SELECT *, close - LAG(close) {W} AS diff FROM bars),
       q AS (SELECT sym, d, close / LAG(close, 10) {W} - 1 AS roc10,
         CASE WHEN rn >= 21 THEN ABS(close - LAG(close, 20) {W}) / SUM(ABS(diff)) {over(-19)} END AS efficiency20 FROM df)""")
def _(t):
    return w.efficiency(t.bars()).withColumn("roc10", w.roc(10))


@query("up_down_streaks", "W26", "sym d:date up_streak dn_streak",
       B1 + f""", s AS (SELECT *, SIGN(close - LAG(close) {W}) AS sg FROM bars),
       t2 AS (SELECT *, SUM(CASE WHEN sg = LAG(sg) {W} THEN 0 ELSE 1 END) {over('-')} AS island FROM (SELECT *, LAG(sg) {W} AS psg FROM s)),
       r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sym, island ORDER BY d) AS k FROM t2),
       q AS (SELECT sym, d, CASE WHEN sg > 0 THEN k ELSE 0 END AS up_streak, CASE WHEN sg < 0 THEN k ELSE 0 END AS dn_streak FROM r)""".replace(
           f"SUM(CASE WHEN sg = LAG(sg) {W} THEN 0 ELSE 1 END)", "SUM(CASE WHEN sg = psg THEN 0 ELSE 1 END)"))
def _(t):
    return w.streak(t.bars())


@query("range_position_windows", "W27", "sym d:date " + " ".join(
           f"close_vs_high_{n}d:6 close_vs_low_{n}d:6 range_pct_{n}d:6" for n in (20, 60, 120, 252)),
       B3 + ", q AS (SELECT sym, d, " + ", ".join(
           f"CASE WHEN rn > {n} THEN close / MAX(close) {over(1 - n)} - 1 END AS close_vs_high_{n}d, "
           f"CASE WHEN rn > {n} THEN close / MIN(close) {over(1 - n)} - 1 END AS close_vs_low_{n}d, "
           f"CASE WHEN rn > {n} THEN MAX(close) {over(1 - n)} / MIN(close) {over(1 - n)} - 1 END AS range_pct_{n}d"
           for n in (20, 60, 120, 252)) + " FROM bars)")
def _(t):
    return w.range_pos(t.brand_bars())


@query("candle_anatomy", "W28", "sym d:date gap_open:6 open_to_close:6 daily_range:6 body_pct:6 upper_wick_pct:6 "
       "lower_wick_pct:6 close_location:6 bullish_candle:0",
       B3 + f""", q AS (SELECT sym, d, CASE WHEN rn > 1 THEN open / LAG(close) {W} - 1 END AS gap_open,
         CASE WHEN rn > 1 THEN close / open - 1 END AS open_to_close, CASE WHEN high > low THEN (high - low) / close END AS daily_range,
         CASE WHEN high > low THEN ABS(close - open) / (high - low) END AS body_pct,
         CASE WHEN high > low THEN (high - GREATEST(close, open)) / (high - low) END AS upper_wick_pct,
         CASE WHEN high > low THEN (LEAST(close, open) - low) / (high - low) END AS lower_wick_pct,
         CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_location,
         CASE WHEN close >= open THEN 1 ELSE 0 END AS bullish_candle FROM bars)""")
def _(t):
    return w.candle(t.brand_bars())


@query("activity_ratios", "W30", "sym d:date avg_volume_20:4 avg_value_20:2 avg_freq_20:4 volume_ratio:6 value_ratio:6 "
       "freq_ratio:6 turnover_ratio:6 confirmation_ratio:6 turnover_pct:6",
       B1 + f""", a AS (SELECT *, CASE WHEN rn > 20 THEN AVG(volume) {over(-20, -1)} END AS avg_volume_20,
         CASE WHEN rn > 20 THEN AVG(value) {over(-20, -1)} END AS avg_value_20,
         CASE WHEN rn > 20 THEN AVG(freq) {over(-20, -1)} END AS avg_freq_20,
         CASE WHEN rn > 20 THEN AVG(volume / shares) {over(-20, -1)} END AS avg_turn FROM bars),
       q AS (SELECT *, volume / avg_volume_20 AS volume_ratio, value / avg_value_20 AS value_ratio, freq / avg_freq_20 AS freq_ratio,
         (volume / shares) / avg_turn AS turnover_ratio, (volume / shares) / avg_turn AS confirmation_ratio,
         volume / shares * 100 AS turnover_pct FROM a)""")
def _(t):
    return w.activity_ratios(t.bars())


@query("relative_activity", "W30", "sym d:date " + " ".join(
           f"rel_volume_{n}d:6 rel_value_{n}d:6 avg_value_{n}d:2" for n in (5, 10, 20, 60)),
       B1 + ", q AS (SELECT sym, d, " + ", ".join(
           f"CASE WHEN rn > {n} THEN volume / (AVG(volume) {over(1 - n)} + 1e-10) END AS rel_volume_{n}d, "
           f"CASE WHEN rn > {n} THEN value / (AVG(value) {over(1 - n)} + 1e-10) END AS rel_value_{n}d, "
           f"CASE WHEN rn > {n} THEN AVG(value) {over(1 - n)} END AS avg_value_{n}d" for n in (5, 10, 20, 60)) + " FROM bars)")
def _(t):
    return w.with_relative_activity(t.bars())


@query("breakouts", "W31", "sym d:date high_20:4 low_20:4 breakout_20:int new_low_20:int",
       ADJ + f""", h AS (SELECT *, MAX(adj_high) {over(-20, -1)} AS high_20, MIN(adj_low) {over(-20, -1)} AS low_20 FROM adjusted),
       q AS (SELECT *, rn > 20 AND COALESCE(adj > high_20, FALSE) AS breakout_20, rn > 20 AND COALESCE(adj < low_20, FALSE) AS new_low_20 FROM h)""")
def _(t):
    return w.breakout(t.bars())


@query("support_resistance_levels", "W32", "sym d:date resistance_20:4 support_20:4 resistance_55:4 support_55:4 "
       "high_52w:4 low_52w:4 from_high_52w:6 from_low_52w:2",
       ADJ + f""", q AS (SELECT sym, d, MAX(adj_high) {over(-19)} AS resistance_20, MIN(adj_low) {over(-19)} AS support_20,
         MAX(adj_high) {over(-54)} AS resistance_55, MIN(adj_low) {over(-54)} AS support_55,
         MAX(adj_high) {over(-251)} AS high_52w, MIN(adj_low) {over(-251)} AS low_52w,
         (adj / MAX(adj_high) {over(-251)} - 1) * 100 AS from_high_52w, (adj / MIN(adj_low) {over(-251)} - 1) * 100 AS from_low_52w FROM adjusted)""")
def _(t):
    return w.levels(w.back_adjust(t.bars()))


def _flow_sql(n: int) -> str:
    f = over(1 - n)
    return (f"CASE WHEN rn >= {n} THEN SUM(net) {f} END AS net_{n}d, CASE WHEN rn >= {n} THEN SUM(net * close) {f} END AS net_value_{n}d, "
            f"CASE WHEN rn >= {n} AND SUM(act) {f} > 0 THEN 100.0 * SUM(CASE WHEN net > 0 THEN 1 ELSE 0 END) {f} / SUM(act) {f} END AS consistency_{n}, "
            f"CASE WHEN rn >= {n} THEN SUM(CASE WHEN net > 0 THEN 1 ELSE 0 END) {f} END AS pos_days_{n}, "
            f"CASE WHEN rn >= {n} THEN SUM(CASE WHEN net < 0 THEN 1 ELSE 0 END) {f} END AS neg_days_{n}, "
            f"CASE WHEN rn >= {n} THEN SUM(CASE WHEN net = 0 THEN 1 ELSE 0 END) {f} END AS flat_days_{n}, "
            f"CASE WHEN rn >= {n} THEN SUM(net) {f} / SUM(volume) {f} * 100 END AS net_volume_pct_{n}")


@query("foreign_flow", "W33", "sym d:date net_1d:2 " + " ".join(
           f"net_{n}d:2 net_value_{n}d:2 consistency_{n}:6 pos_days_{n}:int neg_days_{n}:int flat_days_{n}:int net_volume_pct_{n}:6" for n in (5, 20)),
       B1 + f""", f AS (SELECT *, fbuy - fsell AS net, CASE WHEN fbuy + fsell > 0 THEN 1 ELSE 0 END AS act FROM bars),
       q AS (SELECT sym, d, net AS net_1d, {_flow_sql(5)}, {_flow_sql(20)} FROM f)""")
def _(t):
    return w.foreign_flow(t.bars())


@query("foreign_flow_ratios", "W34", "sym d:date " + " ".join(
           f"foreign_net_{n}d:9 foreign_buy_{n}d:9 foreign_sell_{n}d:9" for n in (1, 5, 10, 20)),
       B1 + ", q AS (SELECT sym, d, " + ", ".join(
           f"CASE WHEN rn >= {n} AND SUM(fbuy) {over('-')} > 0 THEN SUM({x}) {over(1 - n)} / (SUM(value) {over(1 - n)} + 1) ELSE 0 END AS foreign_{nm}_{n}d"
           for n in (1, 5, 10, 20) for nm, x in (("net", "fbuy - fsell"), ("buy", "fbuy"), ("sell", "fsell"))) + " FROM bars)")
def _(t):
    return w.with_rn(t.bars()).withColumns(w.foreign_ratio())


@query("illiquidity", "W35", "sym d:date price_impact_20:2 amihud_20:12 amihud_bn_20:2 zero_vol_20:6 active_pct_20:6",
       B1 + f""", i AS (SELECT *, CASE WHEN prev > 0 AND value > 0 THEN ABS(close / prev - 1) * 100 / (value / 1e9) END AS imp,
         ABS(close / LAG(close) {W} - 1) / (value + 1) AS am, ABS(close / LAG(close) {W} - 1) / value * 1e9 AS ambn,
         CASE WHEN volume > 0 THEN 0 ELSE 1 END AS idle FROM bars),
       q AS (SELECT sym, d, CASE WHEN rn >= 20 THEN AVG(imp) {over(-19)} END AS price_impact_20,
         CASE WHEN rn >= 20 THEN AVG(am) {over(-19)} END AS amihud_20, CASE WHEN rn >= 20 THEN AVG(ambn) {over(-19)} END AS amihud_bn_20,
         CASE WHEN rn >= 20 THEN AVG(idle) {over(-19)} END AS zero_vol_20,
         CASE WHEN rn >= 20 THEN (1 - AVG(idle) {over(-19)}) * 100 END AS active_pct_20 FROM i)""")
def _(t):
    return w.illiquidity(t.bars())


@query("liquidity_score", "W36", "sym d:date med_value:3 med_freq:2 liq_score:6 liq_level",
       B1 + f""", m AS (SELECT *, CASE WHEN rn >= 20 THEN quantile_cont(value, 0.5) {over(-19)} END AS med_value,
         CASE WHEN rn >= 20 THEN quantile_cont(CAST(freq AS DOUBLE), 0.5) {over(-19)} END AS med_freq FROM bars),
       s AS (SELECT *, 50 * LEAST(med_value / 1e10, 1) + 50 * LEAST(med_freq / 1000, 1) AS liq_score FROM m WHERE med_value IS NOT NULL OR rn < 20),
       q AS (SELECT sym, d, med_value, med_freq, CASE WHEN med_value IS NULL THEN NULL ELSE liq_score END AS liq_score,
         CASE WHEN med_value IS NULL THEN NULL WHEN liq_score >= 80 THEN 'high' WHEN liq_score >= 50 THEN 'medium' ELSE 'low' END AS liq_level FROM s)""")
def _(t):
    return w.liquidity_score(t.bars())


@query("foreign_flow_share_of_value", "W37", "sym d:date flow_net_20:2 flow_pct_20:9",
       B1 + f""", q AS (SELECT sym, d, CASE WHEN rn >= 20 THEN SUM(fbuy - fsell) {over(-19)} END AS flow_net_20,
         CASE WHEN rn >= 20 THEN SUM(fbuy - fsell) {over(-19)} / (2 * SUM(value) {over(-19)}) * 100 END AS flow_pct_20 FROM bars)""")
def _(t):
    return w.with_rn(t.bars()).withColumns(w.flow_20d())


@query("volume_price_correlation", "W38", "sym d:date corr5:5",
       B1 + f", q AS (SELECT sym, d, CASE WHEN rn >= 5 THEN CORR(volume, close) {over(-4)} END AS corr5 FROM bars)")
def _(t):
    return w.with_rn(t.bars()).withColumn("corr5", w.vol_price_corr(5))


@query("quote_metrics", "W39", "sym d:date spread:6 depth:6",
       B1 + """, q AS (SELECT sym, d, (high - low) / ((high + low) / 2) * 100 AS spread,
         CASE WHEN fbuy + fsell <> 0 THEN (fbuy - fsell) / (fbuy + fsell) * 100 END AS depth FROM bars)""")
def _(t):
    return t.bars(windows=False).withColumns({"spread": spread_pct("low", "high"), "depth": depth_imbalance("fbuy", "fsell")})


@query("corporate_actions", "W40", "sym d:date share_ratio:6 price_ratio:6 action confidence",
       B1 + f""", s AS (SELECT *, CASE WHEN month(d) % 3 = 0 THEN 2 ELSE 1 END * shares AS sh FROM bars WHERE volume > 0),
       l AS (SELECT *, CAST(sh AS DOUBLE) / LAG(sh) {W} AS share_ratio, LAG(close) {W} / close AS price_ratio FROM s),
       c AS (SELECT *, ABS(share_ratio - 1) > 0.05 AND ABS(share_ratio - price_ratio) / GREATEST(share_ratio, price_ratio) <= 0.25
         AND ((share_ratio > 1 AND price_ratio > 1.02) OR (share_ratio < 1 AND price_ratio < 0.98)) AS fits FROM l WHERE ABS(share_ratio - 1) > 0.01),
       q AS (SELECT *, CASE WHEN fits THEN 'SPLIT_LIKE' ELSE 'CAPITAL_CHANGE' END AS action, CASE WHEN fits THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM c)""")
def _(t):
    doubled = F.when(F.month("d") % 3 == 0, 2).otherwise(1) * F.col("shares")
    return w.corporate_actions(t.bars().withColumn("shares", doubled))


@query("local_bottoms", "W41", "sym d:date close:4",
       B3 + f""", c AS (SELECT *, list(close) {over(-20, 20)} AS xs FROM bars),
       q AS (SELECT * FROM c WHERE len(xs) = 41 AND close = list_min(xs) AND len(list_filter(xs, lambda v: v = close)) = 1)""")
def _(t):
    return t.brand_bars().withColumn("bottom", w.local_bottoms(20)).filter("bottom")


@query("sparklines", "W44", "sym d:date points first_point:4 last_point:4 low_point:4",
       B1 + f""", c AS (SELECT *, list(close) {over(-29)} AS xs FROM bars),
       q AS (SELECT sym, d, len(xs) AS points, xs[1] AS first_point, xs[-1] AS last_point, list_min(xs) AS low_point FROM c)""")
def _(t):
    df = t.bars().withColumn("xs", w.sparkline(30))
    return df.select("sym", "d", F.size("xs").alias("points"), F.element_at("xs", 1).alias("first_point"),
                     F.element_at("xs", -1).alias("last_point"), F.array_min("xs").alias("low_point"))


@query("downsampled_series", "P16", "sym d:date close:4",
       B1 + f""", n AS (SELECT sym, MAX(rn) AS cnt FROM bars GROUP BY sym),
       target AS (SELECT sym, UNNEST(range(0, 60)) AS k, cnt FROM n),
       pick AS (SELECT DISTINCT sym, CASE WHEN cnt <= 60 THEN k ELSE CAST(FLOOR(k * ((cnt - 1) / 59) + 0.5) AS BIGINT) END AS i FROM target),
       q AS (SELECT b.* FROM bars b JOIN pick p ON p.sym = b.sym AND p.i = b.rn - 1)""")
def _(t):
    return w.downsample(t.bars(), 60)


# ---- recurrences: SQL twins run a list reduction that appends one value per row ---------------------

def reduce_sql(xs: str, alpha: str) -> str:
    """The whole series of e = alpha * x + (1 - alpha) * e, seeded with the first element."""
    return (f"list_reduce(list_transform({xs}, lambda x: [CAST(x AS DOUBLE)]), "
            f"lambda a, x: list_append(a, {alpha} * x[1] + (1 - {alpha}) * a[len(a)]))")


def seeded_sql(xs: str, n: int, alpha: str) -> str:
    """Series over a list whose first n values are replaced by their mean (result starts at value n)."""
    return reduce_sql(f"list_concat([list_avg({xs}[1:{n}])], {xs}[{n + 1}:])", alpha)


SERIES = """diffs AS (SELECT *, close - LAG(close) OVER (PARTITION BY sym ORDER BY d) AS df,
    GREATEST(high - low, ABS(high - LAG(close) OVER (PARTITION BY sym ORDER BY d)), ABS(low - LAG(close) OVER (PARTITION BY sym ORDER BY d))) AS tr,
    LAG(close) OVER (PARTITION BY sym ORDER BY d) AS c1 FROM bars),
  series AS (SELECT sym, COUNT(*) AS n, list(d ORDER BY d) AS ds, list(close ORDER BY d) AS cs,
    list(GREATEST(df, 0) ORDER BY d) FILTER (WHERE c1 IS NOT NULL) AS gs, list(GREATEST(-df, 0) ORDER BY d) FILTER (WHERE c1 IS NOT NULL) AS ls,
    list(CASE WHEN c1 IS NULL THEN high - low ELSE tr END ORDER BY d) AS trs FROM diffs GROUP BY sym)"""


@query("ema_first_value_seed", "W9", "sym d:date ema5:4 ema20:4 ema100:4",
       B1 + f""", {SERIES}, e AS (SELECT *, {reduce_sql('cs', '(2.0::DOUBLE / 6)')} AS e5, {reduce_sql('cs', '(2.0::DOUBLE / 21)')} AS e20,
         {reduce_sql('cs', '(2.0::DOUBLE / 101)')} AS e100 FROM series),
       u AS (SELECT sym, UNNEST(ds) AS d, UNNEST(e5) AS x5, UNNEST(e20) AS x20, UNNEST(e100) AS x100, UNNEST(range(1, n + 1)) AS i FROM e),
       q AS (SELECT sym, d, CASE WHEN i >= 5 THEN x5 END AS ema5, CASE WHEN i >= 20 THEN x20 END AS ema20, CASE WHEN i >= 100 THEN x100 END AS ema100 FROM u)""")
def _(t):
    return with_recurrences(t.bars().select("sym", "d", "high", "low", "close"),
                            [(f"ema{n}", "ema", {"n": n}) for n in (5, 20, 100)])


@query("ema_mean_seed", "W8", "sym d:date ema9:4 ema55:4",
       B1 + f""", {SERIES}, e AS (SELECT *, {seeded_sql('cs', 9, '(2.0::DOUBLE / 10)')} AS e9, {seeded_sql('cs', 55, '(2.0::DOUBLE / 56)')} AS e55 FROM series),
       u AS (SELECT sym, UNNEST(ds) AS d, UNNEST(range(1, n + 1)) AS i, e9, e55 FROM e),
       q AS (SELECT sym, d, CASE WHEN i >= 9 THEN e9[i - 8] END AS ema9, CASE WHEN i >= 55 THEN e55[i - 54] END AS ema55 FROM u)""")
def _(t):
    return with_recurrences(t.bars().select("sym", "d", "high", "low", "close"),
                            [("ema9", "ema_sma", {"n": 9}), ("ema55", "ema_sma", {"n": 55})])


@query("rsi_wilder", "W6", "sym d:date rsi14:5",
       B1 + f""", {SERIES}, e AS (SELECT *, {seeded_sql('gs', 14, '(1.0::DOUBLE / 14)')} AS g, {seeded_sql('ls', 14, '(1.0::DOUBLE / 14)')} AS l FROM series),
       u AS (SELECT sym, UNNEST(ds) AS d, UNNEST(range(1, n + 1)) AS i, g, l FROM e),
       q AS (SELECT sym, d, CASE WHEN i < 15 THEN NULL WHEN l[i - 14] <= 0 THEN 100 ELSE 100 - 100 / (1 + g[i - 14] / l[i - 14]) END AS rsi14 FROM u)""")
def _(t):
    return with_recurrences(t.bars().select("sym", "d", "high", "low", "close"), [("rsi14", "rsi_wilder", {"n": 14})])


@query("rsi_exponential", "W7", "sym d:date rsi14:5 rsi5:5",
       B1 + f""", {SERIES}, e AS (SELECT *, {reduce_sql('gs', '(1.0::DOUBLE / 14)')} AS g, {reduce_sql('ls', '(1.0::DOUBLE / 14)')} AS l,
         {reduce_sql('gs', '(1.0::DOUBLE / 5)')} AS g5, {reduce_sql('ls', '(1.0::DOUBLE / 5)')} AS l5 FROM series),
       u AS (SELECT sym, UNNEST(ds) AS d, UNNEST(range(1, n + 1)) AS i, g, l, g5, l5 FROM e),
       q AS (SELECT sym, d, CASE WHEN i >= 15 AND l[i - 1] <> 0 THEN 100 - 100 / (1 + g[i - 1] / l[i - 1]) END AS rsi14,
         CASE WHEN i >= 6 AND l5[i - 1] <> 0 THEN 100 - 100 / (1 + g5[i - 1] / l5[i - 1]) END AS rsi5 FROM u)""")
def _(t):
    return with_recurrences(t.bars().select("sym", "d", "high", "low", "close"),
                            [("rsi14", "rsi_ewm", {"n": 14}), ("rsi5", "rsi_ewm", {"n": 5})])


@query("atr_recursive", "W12 W13", "sym d:date atr_w:4 atr_e:4",
       B1 + f""", {SERIES}, e AS (SELECT *, {seeded_sql('trs[2:]', 14, '(1.0::DOUBLE / 14)')} AS w, {reduce_sql('trs', '(1.0::DOUBLE / 14)')} AS x FROM series),
       u AS (SELECT sym, UNNEST(ds) AS d, UNNEST(range(1, n + 1)) AS i, w, x FROM e),
       q AS (SELECT sym, d, CASE WHEN i >= 15 THEN w[i - 14] END AS atr_w, CASE WHEN i >= 14 THEN x[i] END AS atr_e FROM u)""")
def _(t):
    return with_recurrences(t.bars().select("sym", "d", "high", "low", "close"),
                            [("atr_w", "atr_wilder", {"n": 14}), ("atr_e", "atr_ewm", {"n": 14})])


def _macd_sql(f: int, s: int, g: int, tag: str) -> str:
    """Mean-seeded MACD as lists: line starts at value s, signal at value s + g - 1."""
    return (f"{tag}f AS (SELECT *, {seeded_sql('cs', f, f'(2.0::DOUBLE / {f + 1})')} AS {tag}_f, {seeded_sql('cs', s, f'(2.0::DOUBLE / {s + 1})')} AS {tag}_s FROM series), "
            f"{tag}l AS (SELECT *, list_transform(range(1, n - {s} + 2), lambda i: {tag}_f[i + {s - f}] - {tag}_s[i]) AS {tag}_line FROM {tag}f), "
            f"{tag}g AS (SELECT *, {seeded_sql(f'{tag}_line', g, f'(2.0::DOUBLE / {g + 1})')} AS {tag}_sig FROM {tag}l)")


@query("macd_mean_seed", "W10", "sym d:date macd_line:4 macd_signal:4 macd_hist:4 fast_line:4 fast_signal:4 fast_hist:4",
       B1 + f""", {SERIES}, {_macd_sql(12, 26, 9, 'm')}, {_macd_sql(2, 10, 2, 'k')},
       mu AS (SELECT sym, UNNEST(ds) AS d, UNNEST(range(1, n + 1)) AS i, m_line, m_sig FROM mg),
       ku AS (SELECT sym, UNNEST(ds) AS d, UNNEST(range(1, n + 1)) AS i, k_line, k_sig FROM kg),
       q AS (SELECT sym, d, CASE WHEN i >= 26 THEN m_line[i - 25] END AS macd_line, CASE WHEN i >= 34 THEN m_sig[i - 33] END AS macd_signal,
         CASE WHEN i >= 34 THEN m_line[i - 25] - m_sig[i - 33] END AS macd_hist,
         CASE WHEN i >= 10 THEN k_line[i - 9] END AS fast_line, CASE WHEN i >= 11 THEN k_sig[i - 10] END AS fast_signal,
         CASE WHEN i >= 11 THEN k_line[i - 9] - k_sig[i - 10] END AS fast_hist FROM mu JOIN ku USING (sym, d, i))""")
def _(t):
    return with_recurrences(t.bars().select("sym", "d", "high", "low", "close"), [
        ("macd", "macd", {}), ("fast", "macd", {"fast": 2, "slow": 10, "signal": 2})])


@query("adx_14", "W22", "sym d:date adx14:5",
       "RECURSIVE " + B1 + f""", mv AS (SELECT *, LAG(close) {W} AS c1, high - LAG(high) {W} AS up, LAG(low) {W} - low AS dn FROM bars),
       ms AS MATERIALIZED (SELECT sym, rn, GREATEST(high - low, ABS(high - c1), ABS(low - c1)) AS tr, CASE WHEN up > dn THEN GREATEST(up, 0) ELSE 0 END AS p,
         CASE WHEN dn > up THEN GREATEST(dn, 0) ELSE 0 END AS m FROM mv WHERE rn > 1),
       sm(sym, rn, t, p, m) AS (
         SELECT sym, CAST(15 AS BIGINT), AVG(tr), AVG(p), AVG(m) FROM ms WHERE rn <= 15 GROUP BY sym HAVING COUNT(*) = 14
         UNION ALL SELECT s.sym, ms.rn, (s.t * 13 + ms.tr) / 14, (s.p * 13 + ms.p) / 14, (s.m * 13 + ms.m) / 14 FROM sm s JOIN ms ON ms.sym = s.sym AND ms.rn = s.rn + 1),
       dx AS MATERIALIZED (SELECT sym, rn, CASE WHEN t <> 0 AND p + m > 0 THEN ABS(p - m) / (p + m) * 100 ELSE 0 END AS x FROM sm),
       ax(sym, rn, a) AS (
         SELECT sym, CAST(28 AS BIGINT), AVG(x) FROM dx WHERE rn <= 28 GROUP BY sym HAVING COUNT(*) = 14
         UNION ALL SELECT s.sym, dx.rn, (s.a * 13 + dx.x) / 14 FROM ax s JOIN dx ON dx.sym = s.sym AND dx.rn = s.rn + 1),
       q AS (SELECT b.sym, b.d, ax.a AS adx14 FROM bars b LEFT JOIN ax ON ax.sym = b.sym AND ax.rn = b.rn AND ax.rn >= 29)""")
def _(t):
    return with_recurrences(t.bars().select("sym", "d", "high", "low", "close"), [("adx14", "adx", {"n": 14})])
