"""Queries over parabolic stops, candlestick events, rotation, seasonality, derived distances, anomaly proxies and entry zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import patterns as p
from ..operators.recurrences import with_recurrences
from ..sources.trades import bars_from_trades, with_reference
from .base import B1, BARS_SQL, TRADES_SQL, Tables, W, over, query

# Five market makers: dense bars, whose open, high, low and close differ.
B5 = TRADES_SQL.replace("'S' || CAST(l_suppkey AS VARCHAR)", "'M' || CAST(l_suppkey % 5 AS VARCHAR)") + ",\n" + BARS_SQL.format(shares="CAST(1000000 AS BIGINT)")


def _makers(t: Tables):
    trades = t.trades().withColumn("sym", F.concat(F.lit("M"), (F.col("l_suppkey") % 5).cast("string")))
    return with_reference(bars_from_trades(
        trades, F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_extendedprice"),
        ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), F.col("l_returnflag")))


@query("parabolic_sar", "2.15", "kind sym d:date stop:4 trend:int",
       "RECURSIVE " + B1 + f""", lg AS MATERIALIZED (SELECT sym, d, rn, high, low, close, LAG(close) {W} AS c1, LAG(high) {W} AS h1, LAG(high, 2) {W} AS h2, LAG(low) {W} AS l1, LAG(low, 2) {W} AS l2 FROM bars),
       st(kind, sym, d, rn, trend, stop, ep, af) AS (
         SELECT kind, sym, d, rn, CASE WHEN up THEN 1 ELSE -1 END, CASE WHEN up THEN l1 ELSE h1 END, CASE WHEN up THEN GREATEST(h1, high) ELSE LEAST(l1, low) END, CAST(0.02 AS DOUBLE)
         FROM (SELECT lg.*, kind, CASE WHEN kind = 'close' THEN close >= c1 ELSE NOT (l1 - low > GREATEST(high - h1, 0)) END AS up FROM lg, (SELECT UNNEST(['close', 'moves']) AS kind) WHERE rn = 2)
         UNION ALL
         SELECT kind, sym, d, rn, CASE WHEN hit THEN -trend ELSE trend END,
           CASE WHEN NOT hit THEN s WHEN trend = 1 THEN GREATEST(ep, high, h1) ELSE LEAST(ep, low, l1) END,
           CASE WHEN hit THEN CASE WHEN trend = 1 THEN low ELSE high END WHEN trend = 1 THEN GREATEST(ep, high) ELSE LEAST(ep, low) END,
           CASE WHEN hit THEN CAST(0.02 AS DOUBLE) WHEN (trend = 1 AND high > ep) OR (trend = -1 AND low < ep) THEN LEAST(af + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE)) ELSE af END
         FROM (SELECT *, CASE WHEN trend = 1 THEN low < s ELSE high > s END AS hit
           FROM (SELECT st.kind, st.trend, st.ep, st.af, b.*, CASE WHEN st.trend = 1 THEN LEAST(st.stop + st.af * (st.ep - st.stop), b.l1, b.l2) ELSE GREATEST(st.stop + st.af * (st.ep - st.stop), b.h1, b.h2) END AS s
             FROM st JOIN lg b ON b.sym = st.sym AND b.rn = st.rn + 1))),
       q AS (SELECT kind, sym, d, stop, trend FROM st)""")
def _(t: Tables):
    both = with_recurrences(t.bars().select("sym", "d", "high", "low", "close"), [("x_close", "sar", {"rule": "close"}), ("x_moves", "sar", {"rule": "moves"})])
    rows = [F.struct(F.lit(k).alias("kind"), F.col(f"x_{k}_sar").alias("stop"), F.col(f"x_{k}_trend").alias("trend")) for k in ("close", "moves")]
    return both.select("sym", "d", F.explode(F.array(*rows)).alias("r")).select("r.*", "sym", "d").where("stop is not null")


def _candle_sql() -> str:
    cases = " UNION ALL ".join(
        f"SELECT sym, d, '{name}' AS pattern FROM line WHERE regexp_full_match(concat_ws('|', {', '.join(('k2', 'k1', 'k0')[3 - n:])}), '{codes}') "
        f"AND {' AND '.join(f'{k} IS NOT NULL' for k in ('k2', 'k1', 'k0')[3 - n:])} AND {condition.replace('fell', f'g{n} < 0').replace('rose', f'g{n} > 0')}"
        for name, (n, codes, condition) in p.PATTERNS.items())
    price = ", ".join(f"LAG({x}, {k}) {W} AS {x}{k}" for x in "ohlc" for k in (1, 2))
    return B5 + f""", sized AS (SELECT sym, d, open AS o, high AS h, low AS l, close AS c, ABS(close - open) AS body, high - low AS span,
         CASE WHEN rn > 10 THEN AVG(ABS(close - open)) {over(-10, -1)} END AS u FROM bars),
       coded AS (SELECT *, CASE WHEN u IS NULL THEN NULL ELSE
         CASE WHEN body <= 0.1 * span THEN 'D' WHEN body >= 1.3 * u THEN 'L' WHEN body <= 0.5 * u THEN 'S' ELSE 'N' END || CASE WHEN c > o THEN 'w' WHEN c < o THEN 'b' ELSE 'e' END
         || CASE WHEN h - GREATEST(o, c) > 0 AND h - GREATEST(o, c) >= CASE WHEN body <= 0.1 * span THEN 0.6 * span ELSE 2 * body END THEN '1' ELSE '0' END
         || CASE WHEN LEAST(o, c) - l > 0 AND LEAST(o, c) - l >= CASE WHEN body <= 0.1 * span THEN 0.6 * span ELSE 2 * body END THEN '1' ELSE '0' END END AS k0 FROM sized),
       line AS (SELECT *, LAG(k0) {W} AS k1, LAG(k0, 2) {W} AS k2, {price}, LAG(c, 1) {W} - LAG(c, 6) {W} AS g1, LAG(c, 2) {W} - LAG(c, 7) {W} AS g2, LAG(c, 3) {W} - LAG(c, 8) {W} AS g3 FROM coded),
       q AS ({cases})"""


@query("candle_events", "2.15", "sym d:date pattern", _candle_sql())
def _(t: Tables):
    return p.candle_events(_makers(t))


INDEX_SQL = "ix AS (SELECT d, CAST(SUM(CAST(value AS DECIMAL(28,4))) AS DOUBLE) / SUM(volume) AS index_close FROM bars GROUP BY d)"


@query("rotation_phases", "2.15", "sym d:date strength:6 momentum:6 phase phase_days direction",
       B5 + f""", {INDEX_SQL}, j AS (SELECT sym, d, close / index_close AS ratio, ROW_NUMBER() {W} AS rn FROM (SELECT sym, bars.d, close, index_close FROM bars JOIN ix ON ix.d = bars.d WHERE index_close > 0)),
       s AS (SELECT *, CASE WHEN rn >= 20 THEN ratio / AVG(ratio) {over(-19)} * 100 END AS strength FROM j),
       m AS (SELECT *, strength / LAG(strength, 5) {W} * 100 AS momentum FROM s),
       r AS (SELECT *, CASE WHEN ABS(strength - 100) >= 0.5 AND ABS(momentum - 100) >= 0.5 THEN
         CASE WHEN strength > 100 AND momentum > 100 THEN 'LEADING' WHEN strength > 100 THEN 'WEAKENING' WHEN momentum > 100 THEN 'IMPROVING' ELSE 'LAGGING' END END AS raw FROM m),
       ph AS (SELECT *, LAST_VALUE(raw IGNORE NULLS) {over('-')} AS phase FROM r),
       st AS (SELECT *, CASE WHEN phase IS NOT NULL AND LAG(phase) {W} IS DISTINCT FROM phase THEN rn END AS first_rn FROM ph),
       q AS (SELECT sym, d, strength, momentum, phase, rn - LAST_VALUE(first_rn IGNORE NULLS) {over('-')} + 1 AS phase_days,
         CASE WHEN momentum > LAG(momentum) {W} THEN 'UP' WHEN momentum < LAG(momentum) {W} THEN 'DOWN' WHEN momentum = LAG(momentum) {W} THEN 'FLAT' END AS direction FROM st)""")
def _(t: Tables):
    return p.rotation(_makers(t))


@query("month_seasonality", "2.15", "sym month_of_year:int years rises rise_p:6 rise_p_lo:6 rise_p_hi:6 mean_return:6 expected_return:6",
       B1 + """, ends AS (SELECT sym, date_trunc('month', d) AS m, arg_max(close, d) AS close FROM bars WHERE close > 0 GROUP BY 1, 2),
       lg AS (SELECT *, LAG(m) OVER (PARTITION BY sym ORDER BY m) AS m1, LAG(close) OVER (PARTITION BY sym ORDER BY m) AS c1 FROM ends),
       rets AS (SELECT sym, month(m) AS month_of_year, close / c1 - 1 AS ret FROM lg WHERE m1 + INTERVAL 1 MONTH = m),
       mk AS (SELECT month_of_year, AVG(ret) AS mm FROM rets GROUP BY 1),
       g AS (SELECT sym, month_of_year, COUNT(*) AS years, COUNT(*) FILTER (ret > 0) AS rises, AVG(ret) AS mean_return FROM rets GROUP BY 1, 2),
       z AS (SELECT g.*, mm, 1.96 * 1.96 AS z2, rises / years AS p FROM g JOIN mk USING (month_of_year)),
       q AS (SELECT sym, month_of_year, years, rises, p AS rise_p, GREATEST((p + z2 / (2 * years) - 1.96 * sqrt(p * (1 - p) / years + z2 / (4 * years * years))) / (1 + z2 / years), 0) AS rise_p_lo,
         LEAST((p + z2 / (2 * years) + 1.96 * sqrt(p * (1 - p) / years + z2 / (4 * years * years))) / (1 + z2 / years), 1) AS rise_p_hi, mean_return,
         (years * mean_return + 5 * mm) / (years + 5) AS expected_return FROM z)""")
def _(t: Tables):
    return p.seasonality(t.bars())


def _z(x: str, n: int) -> str:
    return f"CASE WHEN rn >= {n} AND STDDEV_SAMP({x}) {over(1 - n)} > 0 THEN ({x} - AVG({x}) {over(1 - n)}) / STDDEV_SAMP({x}) {over(1 - n)} END"


@query("derived_daily_table", "2.15", "sym d:date zscore_5:4 zscore_20:4 zscore_60:4 volume_zscore_20:4 drawdown_20:6 drawdown_60:6 cci_20:3 donchian_high:4 donchian_low:4 donchian_place:6",
       B5 + f""", tp AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
       fr AS (SELECT *, AVG(tp) {over(-19)} AS tm, list(tp) {over(-19)} AS frame, CASE WHEN rn > 20 THEN MAX(high) {over(-20, -1)} END AS donchian_high,
         CASE WHEN rn > 20 THEN MIN(low) {over(-20, -1)} END AS donchian_low FROM tp),
       q AS (SELECT sym, d, {_z('close', 5)} AS zscore_5, {_z('close', 20)} AS zscore_20, {_z('close', 60)} AS zscore_60, {_z('volume', 20)} AS volume_zscore_20,
         CASE WHEN rn >= 20 THEN close / MAX(close) {over(-19)} - 1 END AS drawdown_20, CASE WHEN rn >= 60 THEN close / MAX(close) {over(-59)} - 1 END AS drawdown_60,
         CASE WHEN rn >= 20 THEN (tp - tm) / nullif(0.015 * list_sum(list_transform(frame, lambda x: ABS(x - tm))) / 20, 0) END AS cci_20, donchian_high, donchian_low,
         (close - donchian_low) / nullif(donchian_high - donchian_low, 0) AS donchian_place FROM fr)""")
def _(t: Tables):
    return p.derived_table(_makers(t))


@query("anomaly_proxies", "2.15", "sym d:date trade_value:6 spread:6 value_z:4 spread_z:4 crossing_proxy:int anomaly_proxy:int top_value:int",
       B1 + """, a AS (SELECT sym, d, ln(value / freq) AS trade_value, (high - low) / close AS spread FROM bars WHERE volume > 0 AND freq > 0 AND close > 0),
       m AS (SELECT *, MEDIAN(trade_value) OVER (PARTITION BY d) AS vm, MEDIAN(spread) OVER (PARTITION BY d) AS sm FROM a),
       x AS (SELECT *, MEDIAN(ABS(trade_value - vm)) OVER (PARTITION BY d) AS vd, MEDIAN(ABS(spread - sm)) OVER (PARTITION BY d) AS sd,
         RANK() OVER (PARTITION BY d ORDER BY trade_value DESC) AS k, COUNT(*) OVER (PARTITION BY d) AS n FROM m),
       z AS (SELECT *, 0.6745 * (trade_value - vm) / nullif(vd, 0) AS value_z, 0.6745 * (spread - sm) / nullif(sd, 0) AS spread_z FROM x),
       q AS (SELECT sym, d, trade_value, spread, value_z, spread_z, COALESCE(value_z > 3.5, FALSE) AND COALESCE(spread_z <= 0, TRUE) AS crossing_proxy,
         COALESCE(value_z > 3.5, FALSE) OR COALESCE(spread_z > 3.5, FALSE) AS anomaly_proxy, k <= GREATEST(1, FLOOR(0.02 * n)) AS top_value FROM z)""")
def _(t: Tables):
    return p.anomaly_proxies(t.bars(windows=False))


@query("entry_zone_outcomes", "2.15 E4", "sym d:date entry_price:4 next_open:4 zone_status decided_on:date realized_return:6",
       B5 + f""", s AS (SELECT sym, d, rn, close, close * 0.4 AS lo, close * 1.6 AS hi, LEAD(open) {W} AS nx, LEAD(d) {W} AS nd, LEAD(close, 5) {W} AS ex, LEAD(d, 5) {W} AS ed FROM bars),
       o AS (SELECT *, COALESCE(nx < lo OR nx > hi, FALSE) AS gone, ex / close - 1 AS ret FROM s WHERE rn % 2 = 0),
       q AS (SELECT sym, d, close AS entry_price, nx AS next_open, CASE WHEN gone THEN 'EXPIRED' WHEN ret >= 0.02 THEN 'HIT' WHEN ret IS NOT NULL THEN 'MISS' ELSE 'PENDING' END AS zone_status,
         CASE WHEN gone THEN nd WHEN ret IS NOT NULL THEN ed END AS decided_on, CASE WHEN NOT gone THEN ret END AS realized_return FROM o)""")
def _(t: Tables):
    bars = _makers(t)
    preds = p.with_rn(bars).where("rn % 2 = 0").select(
        "sym", "d", F.col("close").alias("entry_price"), (F.col("close") * 0.4).alias("zone_low"), (F.col("close") * 1.6).alias("zone_high"),
        F.lit(5).alias("horizon_days"), F.lit(0.02).alias("expected_upside"))
    return ev.zone_outcomes(preds, bars)
