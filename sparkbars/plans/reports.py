"""Queries over accumulation, brokers, ownership, joins, fundamentals and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers, prices, text
from ..operators import accumulate as a
from ..operators import brokers as b
from ..operators import fundamentals as f
from ..operators import joins as j
from ..operators import ownership as o
from ..operators import scale
from ..operators import windows as w
from .base import B1, B2, B3, MASTER, Tables, W, over, query
from .indicators import _sma_sql

# ---- accumulation ------------------------------------------------------------------------------

ACC = """COUNT(*) AS active_days, MIN(d) AS start_date, MAX(d) AS end_date, CAST(SUM(volume) AS BIGINT) AS volume,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, CAST(SUM(freq) AS BIGINT) AS freq, SUM(fbuy - fsell) AS net_foreign,
  SUM((fbuy - fsell) * close) AS net_foreign_value, MIN(low) AS low, MAX(high) AS high, arg_min(close, d) AS start_price,
  MAX(CASE WHEN first_d = d THEN prev END) AS start_prev, arg_max(close, d) AS end_price"""
DERIVED = """*, end_price - COALESCE(start_prev, start_price) AS change, (end_price - COALESCE(start_prev, start_price)) / COALESCE(start_prev, start_price) * 100 AS change_pct, value / volume AS vwap"""
ACC_SPEC = "active_days start_date:date end_date:date volume value:2 freq net_foreign:2 net_foreign_value:2 low:4 high:4 start_price:4 end_price:4 change:4 change_pct:6 vwap:4"


@query("accumulation_one_year", "A7 J5 P10", "sym " + ACC_SPEC,
       B1 + f""", r AS (SELECT *, MIN(d) OVER (PARTITION BY sym) AS first_d FROM bars WHERE d >= (SELECT MAX(d) FROM bars) - 364),
       g AS (SELECT sym, {ACC} FROM r GROUP BY sym), q AS (SELECT {DERIVED} FROM g)""")
def _(t: Tables):
    bars = t.bars()
    return a.accumulate(bars, dates.period_start(dates.latest_date(bars), "year"))


@query("accumulation_custom_range", "A7 D2", "sym " + ACC_SPEC,
       B1 + f""", r AS (SELECT *, MIN(d) OVER (PARTITION BY sym) AS first_d FROM bars WHERE d BETWEEN DATE '1997-03-01' AND DATE '1998-02-15'),
       g AS (SELECT sym, {ACC} FROM r GROUP BY sym), q AS (SELECT {DERIVED} FROM g)""")
def _(t: Tables):
    return a.accumulate(t.bars(), F.lit("1997-03-01").cast("date"), F.lit("1998-02-15").cast("date"))


KEYS_SQL = {
    "day": "CAST(d AS VARCHAR)", "week": "strftime(d, '%Y-W%W')", "month": "strftime(d, '%Y-%m')", "quarter": "year(d) || '-Q' || quarter(d)",
    "half": "year(d) || '-H' || CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END", "year": "CAST(year(d) AS VARCHAR)",
    "2y": "(year(d) // 2 * 2) || '-' || (year(d) // 2 * 2 + 1)",
    "3y": "(CAST(trunc((year(d) - 2020) / 3) AS INT) * 3 + 2020) || '-' || (CAST(trunc((year(d) - 2020) / 3) AS INT) * 3 + 2022)",
    "5y": "(CAST(trunc((year(d) - 2020) / 5) AS INT) * 5 + 2020) || '-' || (CAST(trunc((year(d) - 2020) / 5) AS INT) * 5 + 2024)", "all": "'all'",
}
COARSE = ("week", "month", "quarter", "half", "year", "2y", "3y", "5y", "all")


@query("accumulation_by_period", "A8 J5", "sym kind period " + ACC_SPEC,
       B1 + ", e AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS kind, {KEYS_SQL[k]} AS period FROM bars" for k in COARSE) + f"""),
       r AS (SELECT *, MIN(d) OVER (PARTITION BY sym, kind, period) AS first_d FROM e),
       g AS (SELECT sym, kind, period, {ACC} FROM r GROUP BY sym, kind, period), q AS (SELECT {DERIVED} FROM g)""")
def _(t: Tables):
    return a.accumulate_by(t.bars(), COARSE)


@query("accumulation_totals", "A17", "symbols net_foreign:2 net_foreign_value:1 value:2",
       B1 + """, q AS (SELECT COUNT(DISTINCT sym) AS symbols, SUM(fbuy - fsell) AS net_foreign, SUM((fbuy - fsell) * close) AS net_foreign_value,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM bars WHERE d >= (SELECT MAX(d) FROM bars) - 364)""")
def _(t: Tables):
    bars = t.bars(windows=False)
    return a.totals(a.accumulate(bars, dates.period_start(dates.latest_date(bars), "year")))


@query("period_keys", "P9", "d:date " + " ".join(f"k_{k}" for k in KEYS_SQL),
       B1 + ", q AS (SELECT DISTINCT d, " + ", ".join(f"{x} AS k_{k}" for k, x in KEYS_SQL.items()) + " FROM bars)")
def _(t: Tables):
    return t.bars(windows=False).select("d").distinct().select("d", *[dates.period_key("d", k).alias(f"k_{k}") for k in dates.PERIOD_KINDS])


@query("trailing_period_starts", "P10", "d:date " + " ".join(f"s_{k}:date" for k in dates.TRAILING_DAYS),
       B1 + ", q AS (SELECT DISTINCT d, " + ", ".join(f"d - {n - 1} AS s_{k}" for k, n in dates.TRAILING_DAYS.items()) + " FROM bars)")
def _(t: Tables):
    return t.bars(windows=False).select("d").distinct().select("d", *[dates.period_start("d", k).alias(f"s_{k}") for k in dates.TRAILING_DAYS])


# ---- brokers ----------------------------------------------------------------------------------------

BROKER_SQL = """daily AS (SELECT CAST(o_orderdate AS DATE) AS d, 'B' || c_nationkey AS broker, SUM(CAST(floor(o_totalprice / 100) AS BIGINT)) AS volume,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, COUNT(*) AS freq FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
  bm AS (SELECT 'B' || n_nationkey AS broker, n_name AS broker_name FROM nation WHERE n_regionkey <> 2)"""


def _brokers(t: Tables):
    j_ = t.table("orders").join(t.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    daily = j_.groupBy(F.col("o_orderdate").cast("date").alias("d"), F.concat(F.lit("B"), F.col("c_nationkey").cast("string")).alias("broker")).agg(
        F.sum(F.floor(F.col("o_totalprice") / 100)).alias("volume"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"), F.count(F.lit(1)).alias("freq"))
    master = t.table("nation").filter(F.col("n_regionkey") != 2).select(
        F.concat(F.lit("B"), F.col("n_nationkey").cast("string")).alias("broker"), F.col("n_name").alias("broker_name"))
    return daily, master


@query("broker_totals", "A9 J2", "rank broker broker_name volume:int value:2 freq:int active_days share_value:6 share_volume:6 share_freq:6",
       BROKER_SQL + """, g AS (SELECT broker, SUM(volume) AS volume, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, SUM(freq) AS freq, COUNT(DISTINCT d) AS active_days
         FROM daily WHERE d BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' GROUP BY broker),
       q AS (SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC, broker) AS rank, value / SUM(value) OVER () * 100 AS share_value,
         volume / SUM(volume) OVER () * 100 AS share_volume, freq / SUM(freq) OVER () * 100 AS share_freq FROM g JOIN bm USING (broker))""")
def _(t: Tables):
    daily, master = _brokers(t)
    return b.broker_totals(daily, master, F.lit("1996-01-01").cast("date"), F.lit("1997-06-30").cast("date"))


@query("broker_months", "A10", "broker month active_days value:2 volume:int freq:int",
       BROKER_SQL + """, q AS (SELECT COALESCE(broker, 'all') AS broker, month, COUNT(DISTINCT d) AS active_days, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value,
         SUM(volume) AS volume, SUM(freq) AS freq FROM (SELECT *, strftime(d, '%Y-%m') AS month FROM daily) GROUP BY GROUPING SETS ((broker, month), (month)))""")
def _(t: Tables):
    return b.broker_monthly(_brokers(t)[0], per_broker=True).withColumn("broker", F.coalesce("broker", F.lit("all")))


@query("broker_months_all", "A10", "month active_days value:2 volume:int freq:int",
       BROKER_SQL + """, q AS (SELECT strftime(d, '%Y-%m') AS month, COUNT(DISTINCT d) AS active_days, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value,
         SUM(volume) AS volume, SUM(freq) AS freq FROM daily GROUP BY 1)""")
def _(t: Tables):
    return b.broker_monthly(_brokers(t)[0])


@query("broker_profiles", "A11 W46", "broker ytd_value:2 ytd_volume:int ytd_freq:int ytd_days rank_ytd",
       BROKER_SQL + """, q AS (SELECT broker, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS ytd_value, SUM(volume) AS ytd_volume, SUM(freq) AS ytd_freq, COUNT(DISTINCT d) AS ytd_days,
         RANK() OVER (ORDER BY SUM(CAST(value AS DECIMAL(18,2))) DESC) AS rank_ytd FROM daily WHERE d BETWEEN DATE '1998-01-01' AND DATE '1998-09-30' GROUP BY broker)""")
def _(t: Tables):
    return b.broker_profile(_brokers(t)[0], F.lit("1998-09-30").cast("date"))


@query("broker_recent_days", "A11", "broker k d:date value:2 volume:int freq",
       BROKER_SQL + ", q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY broker ORDER BY d DESC) AS k FROM daily QUALIFY k <= 252)")
def _(t: Tables):
    return b.broker_history(_brokers(t)[0])


# ---- ownership --------------------------------------------------------------------------------------

OWN_SQL = """own AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS record_date, n_name AS sym, c_name AS investor,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'ID' WHEN 'MACHINERY' THEN 'Corporate Ltd' WHEN 'FURNITURE' THEN 'MF' WHEN 'BUILDING' THEN 'Pension Fund' ELSE c_mktsegment END AS class,
    CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'L' ELSE 'N' END AS origin, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS shares,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) / 1e6 AS pct
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
  ranked AS (SELECT *, DENSE_RANK() OVER (PARTITION BY sym ORDER BY record_date DESC) AS k FROM own)"""


def _own(t: Tables):
    j_ = (t.table("orders").join(t.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
          .join(t.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")))
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 3
    cls = (F.when(seg == "HOUSEHOLD", "ID").when(seg == "MACHINERY", "Corporate Ltd").when(seg == "FURNITURE", "MF")
           .when(seg == "BUILDING", "Pension Fund").otherwise(seg))
    shares = F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 0).cast("long")
    return j_.groupBy(
        F.last_day(F.col("o_orderdate").cast("date")).alias("record_date"), F.col("n_name").alias("sym"), F.col("c_name").alias("investor"),
        cls.alias("class"), F.when(k == 0, "F").when(k == 1, "L").otherwise("N").alias("origin"),
    ).agg(shares.alias("shares")).withColumn("pct", F.col("shares") / 1e6)


DIFF_SQL = OWN_SQL + """, c1 AS (SELECT * FROM ranked WHERE k = 1), c2 AS (SELECT * FROM ranked WHERE k = 2),
  diff AS (SELECT COALESCE(c1.sym, c2.sym) AS sym, COALESCE(c1.investor, c2.investor) AS investor, CASE WHEN c2.sym IS NULL THEN 'New' WHEN c1.sym IS NULL THEN 'Exited' ELSE 'Active' END AS status,
    COALESCE(c1.shares, 0) - COALESCE(c2.shares, 0) AS share_change, COALESCE(c1.pct, 0) - COALESCE(c2.pct, 0) AS pct_change
    FROM c1 FULL JOIN c2 ON c1.sym = c2.sym AND upper(c1.investor) = upper(c2.investor))"""


@query("ownership_changes", "J9", "sym investor status share_change pct_change:6", DIFF_SQL + ", q AS (SELECT * FROM diff)")
def _(t: Tables):
    return o.snapshot_diff(_own(t))


@query("ownership_top_changes", "J9", "sym investor status share_change rank",
       DIFF_SQL + ", q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY ABS(share_change) DESC, investor) AS rank FROM diff QUALIFY rank <= 10)")
def _(t: Tables):
    return o.top_changes(_own(t))


@query("ownership_concentration", "A13", "sym record_date:date positions concentration_pct:5 foreign_pct:5",
       OWN_SQL + ", q AS (SELECT sym, record_date, COUNT(*) AS positions, SUM(pct) AS concentration_pct, SUM(CASE WHEN origin = 'F' THEN pct ELSE 0 END) AS foreign_pct FROM ranked WHERE k = 1 GROUP BY sym, record_date)")
def _(t: Tables):
    return o.concentration(_own(t))


@query("ownership_top_positions", "A13", "sym investor shares rank",
       OWN_SQL + ", q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY pct DESC, shares DESC, investor) AS rank FROM ranked WHERE k = 1 QUALIFY rank <= 10)")
def _(t: Tables):
    return o.top_positions(_own(t))


@query("ownership_dashboard", "A12", "month positions investors shares:int monitored_pct:6 non_scrip_pct:6 foreign_pct:6 local_pct:6",
       OWN_SQL + """, q AS (SELECT strftime(record_date, '%Y-%m') AS month, COUNT(*) AS positions, COUNT(DISTINCT upper(trim(investor))) AS investors, SUM(shares) AS shares,
         SUM(shares) / 1e9 * 100 AS monitored_pct, SUM(CASE WHEN origin = 'N' THEN shares ELSE 0 END) / 1e9 * 100 AS non_scrip_pct,
         SUM(CASE WHEN origin = 'F' THEN shares ELSE 0 END) / SUM(shares) * 100 AS foreign_pct, SUM(CASE WHEN origin <> 'F' THEN shares ELSE 0 END) / SUM(shares) * 100 AS local_pct FROM own GROUP BY 1)""")
def _(t: Tables):
    return o.dashboard(_own(t), 1_000_000_000)


@query("ownership_class_counts", "A12 P14", "month holder_class positions",
       OWN_SQL + """, q AS (SELECT strftime(record_date, '%Y-%m') AS month, CASE class WHEN 'ID' THEN 'Individual' WHEN 'Corporate Ltd' THEN 'Corporate' WHEN 'MF' THEN 'Fund / Asset Manager' ELSE class END AS holder_class,
         COUNT(*) AS positions FROM own GROUP BY 1, 2)""")
def _(t: Tables):
    return o.class_counts(_own(t))


@query("ownership_top_holders", "A12", "month sym investor shares rank",
       OWN_SQL + ", q AS (SELECT *, strftime(record_date, '%Y-%m') AS month, ROW_NUMBER() OVER (PARTITION BY strftime(record_date, '%Y-%m') ORDER BY shares DESC, sym, investor) AS rank FROM own QUALIFY rank <= 10)")
def _(t: Tables):
    return o.top_holders(_own(t))


@query("sector_counts", "A14", "rank sector symbols",
       MASTER + ", g AS (SELECT sector, COUNT(*) AS symbols FROM master GROUP BY sector), q AS (SELECT *, ROW_NUMBER() OVER (ORDER BY symbols DESC, sector) AS rank FROM g QUALIFY rank <= 10)")
def _(t: Tables):
    return o.sector_counts(t.master())


@query("ownership_named_view", "S22", "sym issuer investor record_date:date shares",
       OWN_SQL + ", q AS (SELECT own.*, r_name AS issuer FROM own JOIN nation ON n_name = sym JOIN region ON r_regionkey = n_regionkey)")
def _(t: Tables):
    n, r = t.table("nation"), t.table("region")
    issuers = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("sym"), F.col("r_name").alias("name"))
    return o.ownership_view(_own(t), issuers)


# ---- joins ------------------------------------------------------------------------------------------

@query("bars_with_names", "J1", "sym d:date name close:4",
       B1 + f", {MASTER}, q AS (SELECT bars.*, COALESCE(NULLIF(CASE WHEN board = 'ASIA' THEN '' ELSE name END, ''), sym) AS name FROM bars LEFT JOIN master USING (sym))")
def _(t: Tables):
    master = t.master().withColumn("name", F.when(F.col("board") == "ASIA", "").otherwise(F.col("name")))
    return j.with_name(t.bars(), master)


@query("bars_of_eligible_symbols", "J4", "sym d:date close:4",
       B1 + f", {MASTER}, q AS (SELECT * FROM bars WHERE sym IN (SELECT sym FROM master WHERE board = 'EUROPE'))")
def _(t: Tables):
    return j.restrict(t.bars(windows=False), t.master().filter(F.col("board") == "EUROPE"))


@query("ohlcv_view", "S22", "date:date ticker open:4 high:4 low:4 close:4 volume",
       B1 + ", q AS (SELECT d AS date, sym AS ticker, open, high, low, close, volume FROM bars)")
def _(t: Tables):
    return j.ohlcv_view(t.bars(windows=False))


FUND_SQL = """fund AS (SELECT 'S' || l_suppkey AS sym, year(l_shipdate) * 10 + quarter(l_shipdate) AS yq, CAST(MAX(l_shipdate) AS DATE) AS as_of, CAST(MAX(l_shipdate) AS DATE) AS synced_at,
    CASE WHEN quarter(MAX(l_shipdate)) = 4 THEN NULL ELSE CAST(COUNT(*) % 30 + 1 AS DOUBLE) END AS per,
    CASE WHEN quarter(MAX(l_shipdate)) = 4 THEN NULL ELSE CAST(COUNT(*) % 50 AS DOUBLE) / 10 END AS pbv,
    CASE WHEN quarter(MAX(l_shipdate)) = 4 THEN NULL ELSE CAST(COUNT(*) % 23 AS DOUBLE) - 4 END AS roe, CAST(COUNT(*) % 11 AS DOUBLE) AS roa,
    CASE WHEN COUNT(*) % 5 = 0 THEN NULL ELSE CAST(COUNT(*) % 7 AS DOUBLE) / 2 END AS der, CAST(COUNT(*) AS DOUBLE) * 1e6 AS market_cap FROM lineitem GROUP BY 1, 2)"""


def _fund(t: Tables):
    """Fundamental snapshots: one per supplier and quarter, with ratios derived from its line count."""
    d = F.col("l_shipdate").cast("date")
    n = F.count(F.lit(1))
    g = t.table("lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sym"),
                                    (F.year(d) * 10 + F.quarter(d)).alias("yq")).agg(F.max(d).alias("as_of"), n.alias("n"))
    rated = lambda x: F.when(F.quarter("as_of") != 4, x)
    c = F.col("n").cast("double")
    return g.withColumns({
        "synced_at": F.col("as_of"), "per": rated(c % 30 + 1), "pbv": rated(c % 50 / 10), "roe": rated(c % 23 - 4), "roa": c % 11,
        "der": F.when(c % 5 != 0, c % 7 / 2), "market_cap": c * 1e6})


@query("latest_fundamentals", "J6", "sym as_of:date per:2 pbv:2 roe:2 der:2",
       FUND_SQL + ", q AS (SELECT * FROM fund QUALIFY ROW_NUMBER() OVER (PARTITION BY sym ORDER BY CASE WHEN per IS NOT NULL OR pbv IS NOT NULL OR roe IS NOT NULL THEN 1 ELSE 0 END DESC, as_of DESC, synced_at DESC) = 1)")
def _(t: Tables):
    return j.latest_fundamental(_fund(t))


@query("newest_fundamental_version", "J6", "sym as_of:date per:2 market_cap:2",
       FUND_SQL + ", q AS (SELECT * FROM fund QUALIFY ROW_NUMBER() OVER (PARTITION BY sym ORDER BY as_of DESC) = 1)")
def _(t: Tables):
    return j.latest_fundamental(_fund(t), prefer_non_null=False)


@query("point_in_time_fundamentals", "J7 J8", "sym d:date as_of_asof:date per:2 roa:2",
       B1 + f", {FUND_SQL}, q AS (SELECT bars.sym, bars.d, fund.as_of AS as_of_asof, fund.per, fund.roa FROM bars ASOF LEFT JOIN fund ON bars.sym = fund.sym AND bars.d >= fund.as_of)")
def _(t: Tables):
    return j.asof_join(t.bars(windows=False).select("sym", "d"), _fund(t), "sym", "d", ["per", "roa"], right_on="as_of")


@query("asof_with_tolerance", "J7", "sym d:date as_of_asof:date roa:2",
       B1 + f""", {FUND_SQL}, x AS (SELECT bars.sym, bars.d, fund.as_of AS as_of, fund.roa FROM bars ASOF LEFT JOIN fund ON bars.sym = fund.sym AND bars.d >= fund.as_of),
       q AS (SELECT sym, d, CASE WHEN d - as_of <= 30 THEN as_of END AS as_of_asof, CASE WHEN d - as_of <= 30 THEN roa END AS roa FROM x)""")
def _(t: Tables):
    return j.asof_join(t.bars(windows=False).select("sym", "d"), _fund(t), "sym", "d", ["roa"], right_on="as_of", tolerance_days=30)


@query("eod_panel", "J10 K12", "sym d:date name close:4 bb_upper:4 bb_lower:4 stoch_k:5 liq_level flow_net_20:2 flow_pct_20:9",
       B1 + f""", {MASTER}, e AS (SELECT *, {_sma_sql(20, 'close')} AS mid, CASE WHEN rn >= 20 THEN STDDEV_SAMP(close) {over(-19)} END AS sd,
         CASE WHEN rn >= 14 AND MAX(high) {over(-13)} <> MIN(low) {over(-13)} THEN 100 * (close - MIN(low) {over(-13)}) / (MAX(high) {over(-13)} - MIN(low) {over(-13)}) END AS stoch_k,
         CASE WHEN rn >= 20 THEN 50 * LEAST(quantile_cont(value, 0.5) {over(-19)} / 1e10, 1) + 50 * LEAST(quantile_cont(CAST(freq AS DOUBLE), 0.5) {over(-19)} / 1000, 1) END AS sc,
         CASE WHEN rn >= 20 THEN SUM(fbuy - fsell) {over(-19)} END AS flow_net_20, CASE WHEN rn >= 20 THEN SUM(fbuy - fsell) {over(-19)} / (2 * SUM(value) {over(-19)}) * 100 END AS flow_pct_20 FROM bars),
       q AS (SELECT e.*, COALESCE(name, sym) AS name, mid + 2 * sd AS bb_upper, mid - 2 * sd AS bb_lower,
         CASE WHEN sc >= 80 THEN 'high' WHEN sc >= 50 THEN 'medium' WHEN sc IS NOT NULL THEN 'low' END AS liq_level FROM e LEFT JOIN master USING (sym))""")
def _(t: Tables):
    tech = w.stoch(w.bollinger(t.bars(), ddof=1), flat="null")
    return j.eod_panel(w.liquidity_score(tech).withColumns(w.flow_20d()), None, None, t.master())


@query("range_positions", "A15 D4", "sym min_close:4 max_close:4 latest_close:4 days range_pos_pct:6",
       B1 + """, g AS (SELECT sym, MIN(close) AS min_close, MAX(close) AS max_close, arg_max(close, d) AS latest_close, COUNT(*) AS days FROM bars GROUP BY sym),
       q AS (SELECT *, (latest_close - min_close) / (max_close - min_close) * 100 AS range_pos_pct FROM g)""")
def _(t: Tables):
    return j.range_position(t.bars())


@query("browse_page", "P4 X9", "sym d:date close:4 net_foreign:2 total:int pages:int page:int",
       B1 + """, f AS (SELECT *, fbuy - fsell AS net_foreign, COUNT(*) OVER () AS total, ROW_NUMBER() OVER (ORDER BY d DESC, sym) AS k FROM bars WHERE d BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'),
       q AS (SELECT *, CAST(CEIL(total / 50) AS BIGINT) AS pages, 3 AS page FROM f WHERE k BETWEEN 101 AND 150)""")
def _(t: Tables):
    return j.browse(t.bars(), start=F.lit("1998-01-01").cast("date"), end=F.lit("1998-12-31").cast("date"), page=3, size=50)


# ---- fundamentals -------------------------------------------------------------------------------------

FIN_SQL = """qs AS (SELECT 'S' || l_suppkey AS sym, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(4,2)) - CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS net_income FROM lineitem GROUP BY 1, 2, 3),
  fin AS (SELECT sym, 'quarterly' AS period_type, last_day(make_date(year, quarter * 3, 1)) AS period_end, year, quarter, revenue, CASE WHEN quarter = 3 AND year % 4 = 1 THEN NULL ELSE net_income END AS net_income, revenue * 2 AS equity FROM qs
    UNION ALL SELECT sym, 'annual', make_date(year, 12, 31), year, NULL, SUM(revenue), SUM(net_income), SUM(revenue) * 2 FROM qs WHERE year % 2 = 0 GROUP BY sym, year)"""


def _fin(t: Tables):
    """Statements per supplier: quarterly sums of its line items, annual ones for even years."""
    d = F.col("l_shipdate").cast("date")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    disc, tax = F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    qs = t.table("lineitem").groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sym"), F.year(d).alias("year"), F.quarter(d).alias("quarter")
    ).agg(F.sum(money * (1 - disc)).cast("double").alias("revenue"), F.sum(money * (disc - tax)).cast("double").alias("net_income"))
    hidden = (F.col("quarter") == 3) & (F.col("year") % 4 == 1)
    quarterly = qs.select(
        "sym", F.lit("quarterly").alias("period_type"), F.last_day(F.make_date("year", F.col("quarter") * 3, F.lit(1))).alias("period_end"),
        "year", "quarter", "revenue", F.when(~hidden, F.col("net_income")).alias("net_income"), (F.col("revenue") * 2).alias("equity"))
    annual = qs.filter(F.col("year") % 2 == 0).groupBy("sym", "year").agg(F.sum("revenue").alias("revenue"), F.sum("net_income").alias("net_income"))
    annual = annual.select(
        "sym", F.lit("annual").alias("period_type"), F.make_date("year", F.lit(12), F.lit(31)).alias("period_end"), "year",
        F.lit(None).cast("int").alias("quarter"), "revenue", "net_income", (F.col("revenue") * 2).alias("equity"))
    return quarterly.unionByName(annual)


_SLOT = {q: f"MAX(CASE WHEN period_type = 'quarterly' AND quarter = {q} THEN {{c}} END) AS {{c}}{q}" for q in (1, 2, 3, 4)}
WIN_SQL = FIN_SQL + ", pv AS (SELECT sym, year, " + ", ".join(
    [_SLOT[q].format(c=c) for q in (1, 2, 3, 4) for c in ("net_income", "revenue", "equity", "period_end")]
    + [f"MAX(CASE WHEN period_type = 'annual' THEN {c} END) AS {c}_y" for c in ("net_income", "revenue", "equity", "period_end")]
) + " FROM fin GROUP BY sym, year), win AS (" + " UNION ALL ".join(
    [f"SELECT sym, year, '{kind}' AS kind, year || '-{label}' AS label, period_end{qq[-1]} AS period_end, {' + '.join(f'net_income{i}' for i in qq)} AS net_income, "
     f"{' + '.join(f'revenue{i}' for i in qq)} AS revenue, equity{qq[-1]} AS equity, CAST({factor!r} AS DOUBLE) AS factor FROM pv WHERE {' AND '.join(f'period_end{i} IS NOT NULL' for i in qq)}"
     for label, kind, qq, factor in f.PERIODS]
    + ["SELECT sym, year, 'annual', CAST(year AS VARCHAR), period_end_y, net_income_y, revenue_y, equity_y, 1.0 FROM pv WHERE period_end_y IS NOT NULL",
       "SELECT sym, year, 'annual', CAST(year AS VARCHAR), period_end4, net_income1 + net_income2 + net_income3 + net_income4, revenue1 + revenue2 + revenue3 + revenue4, equity4, 1.0 FROM pv "
       "WHERE period_end_y IS NULL AND period_end1 IS NOT NULL AND period_end2 IS NOT NULL AND period_end3 IS NOT NULL AND period_end4 IS NOT NULL"]) + ")"
SHARES_SQL = "sh AS (SELECT 'S' || s_suppkey AS sym, 1000000 + 1000 * s_suppkey AS shares FROM supplier)"
VAL_SQL = B1 + ", " + WIN_SQL + f""", {SHARES_SQL},
  pr AS (SELECT win.*, bars.close AS price FROM win ASOF LEFT JOIN bars ON win.sym = bars.sym AND win.period_end >= bars.d),
  val0 AS (SELECT pr.*, shares, net_income * factor AS income_annualised, net_income * factor / shares AS eps, equity / shares AS bvps, price * shares AS market_cap FROM pr JOIN sh USING (sym)),
  val AS (SELECT *, CASE WHEN eps > 0 AND ABS(price / eps) <= 500 THEN price / eps END AS per, CASE WHEN bvps > 0 AND ABS(price / bvps) <= 100 THEN price / bvps END AS pbv FROM val0)"""
PROJ_SQL = f""", an AS (SELECT *, LAG(net_income) OVER (PARTITION BY sym ORDER BY year) AS p FROM win WHERE kind = 'annual' AND net_income IS NOT NULL),
  gr AS (SELECT sym, AVG(CASE WHEN p > 0 THEN net_income / p - 1 END) AS growth, MAX(year) AS last_year, arg_max(net_income, year) AS last_income, arg_max(equity, year) AS equity FROM an GROUP BY sym),
  pj0 AS (SELECT gr.*, shares, (SELECT arg_max(close, d) FROM bars WHERE bars.sym = gr.sym) AS price, last_income * (1 + growth) AS income_annualised FROM gr JOIN sh USING (sym) WHERE growth IS NOT NULL AND last_income > 0),
  pj1 AS (SELECT *, (last_year + 1) || '-Projection' AS label, income_annualised / shares AS eps, equity / shares AS bvps, price * shares AS market_cap FROM pj0),
  pj AS (SELECT *, CASE WHEN eps > 0 AND ABS(price / eps) <= 500 THEN price / eps END AS per, CASE WHEN bvps > 0 AND ABS(price / bvps) <= 100 THEN price / bvps END AS pbv FROM pj1)"""


def _shares(t: Tables):
    k = F.col("s_suppkey")
    return t.table("supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("sym"), (1_000_000 + 1000 * k).alias("shares"))


@query("statement_windows", "F1", "sym year:int kind label period_end:date net_income:3 revenue:3 equity:3 factor:6", WIN_SQL + ", q AS (SELECT * FROM win)")
def _(t: Tables):
    return f.period_windows(_fin(t))


@query("valuation_windows", "F2 J7", "sym label price:4 eps:6 bvps:6 per:6 pbv:3 market_cap:1", VAL_SQL + ", q AS (SELECT * FROM val)")
def _(t: Tables):
    return f.valuation(f.period_windows(_fin(t)), t.bars(), _shares(t))


@query("income_projection", "F3", "sym label growth:6 income_annualised:3 per:6 pbv:3", VAL_SQL + PROJ_SQL + ", q AS (SELECT * FROM pj)")
def _(t: Tables):
    return f.project_income(f.period_windows(_fin(t)), t.bars(), _shares(t))


@query("valuation_history", "F5", "sym kind label eps:6 per:6 is_projected:int",
       VAL_SQL + PROJ_SQL + """, q AS (SELECT sym, kind, label, eps, per, 0 AS is_projected FROM val UNION ALL SELECT sym, 'projection', label, eps, per, 1 FROM pj)""")
def _(t: Tables):
    win = f.period_windows(_fin(t))
    bars = t.bars()
    return f.valuation_history(f.valuation(win, bars, _shares(t)), f.project_income(win, bars, _shares(t)))


@query("growth_screen", "F4", "sym category income_streak:int income_comparisons:int revenue_streak:int quarterly_income_streak:int income_cagr_pct:5 revenue_cagr_pct:5 latest_annual_period:date latest_quarterly_period:date",
       FIN_SQL + """, v AS (SELECT sym, period_type, period_end, 'i' AS m, net_income AS x FROM fin WHERE net_income IS NOT NULL UNION ALL SELECT sym, period_type, period_end, 'r', revenue FROM fin),
       n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sym, period_type, m ORDER BY period_end) AS i, LAG(x) OVER (PARTITION BY sym, period_type, m ORDER BY period_end) AS p FROM v),
       g AS (SELECT sym, period_type, m, MAX(i) AS n, MAX(i) - MAX(i) FILTER (WHERE p IS NULL OR x <= p) AS streak, arg_min(x, i) AS f, arg_max(x, i) AS l, MAX(period_end) AS latest FROM n GROUP BY 1, 2, 3),
       c AS (SELECT *, CASE WHEN n >= 2 AND f > 0 AND l > 0 THEN (POW(l / f, 1.0 / (n - 1)) - 1) * 100 END AS rate FROM g),
       r AS (SELECT sym, COALESCE(MAX(streak) FILTER (WHERE period_type = 'annual' AND m = 'i'), 0) AS income_streak, COALESCE(MAX(n - 1) FILTER (WHERE period_type = 'annual' AND m = 'i'), 0) AS income_comparisons,
         COALESCE(MAX(streak) FILTER (WHERE period_type = 'annual' AND m = 'r'), 0) AS revenue_streak, COALESCE(MAX(streak) FILTER (WHERE period_type = 'quarterly' AND m = 'i'), 0) AS quarterly_income_streak,
         MAX(rate) FILTER (WHERE period_type = 'annual' AND m = 'i') AS income_cagr_pct, MAX(rate) FILTER (WHERE period_type = 'annual' AND m = 'r') AS revenue_cagr_pct,
         MAX(latest) FILTER (WHERE period_type = 'annual' AND m = 'i') AS latest_annual_period, MAX(latest) FILTER (WHERE period_type = 'quarterly' AND m = 'i') AS latest_quarterly_period FROM c GROUP BY sym),
       q AS (SELECT *, CASE WHEN income_comparisons >= 2 AND income_streak = income_comparisons THEN 'consistent_compounder' WHEN income_comparisons >= 1 AND income_streak >= 1 THEN 'growing'
         WHEN income_comparisons >= 1 AND income_streak = 0 THEN 'declining' ELSE 'volatile' END AS category FROM r)""")
def _(t: Tables):
    return f.growth(_fin(t))


SCREEN_SQL = B1 + f""", {FUND_SQL}, nf AS (SELECT * FROM fund QUALIFY ROW_NUMBER() OVER (PARTITION BY sym ORDER BY CASE WHEN per IS NOT NULL OR pbv IS NOT NULL OR roe IS NOT NULL THEN 1 ELSE 0 END DESC, as_of DESC) = 1),
  rp AS (SELECT sym, MIN(close) AS lo, MAX(close) AS hi, arg_max(close, d) AS latest_close FROM bars GROUP BY sym),
  cat AS (SELECT nf.*, latest_close, (latest_close - lo) / (hi - lo) * 100 AS range_pos_pct, list_filter([CASE WHEN roe >= 12 AND pbv <> 0 AND pbv <= 1.5 AND (der IS NULL OR der <= 1.5) THEN 'super_value' END,
    CASE WHEN roe >= 15 OR roa >= 8 THEN 'quality_growth' END, CASE WHEN pbv <> 0 AND pbv <= 0.8 AND (roe < 0 OR der > 2.5) THEN 'value_trap' END,
    CASE WHEN pbv >= 4 AND (roe IS NULL OR roe < 5) THEN 'overvalued' END], lambda x: x IS NOT NULL) AS cs FROM nf LEFT JOIN rp USING (sym)),
  scr AS (SELECT *, CASE WHEN len(cs) > 0 THEN cs ELSE ['neutral'] END AS categories FROM cat)"""


@query("value_screen", "F6", "sym latest_close:4 range_pos_pct:6 categories:arr", SCREEN_SQL + ", q AS (SELECT * FROM scr)")
def _(t: Tables):
    return f.quant_screen(j.latest_fundamental(_fund(t)), j.range_position(t.bars()))


@query("value_screen_counts", "F6", "category symbols", SCREEN_SQL + ", u AS (SELECT UNNEST(categories) AS category FROM scr), q AS (SELECT category, COUNT(*) AS symbols FROM u GROUP BY category)")
def _(t: Tables):
    return f.category_counts(f.quant_screen(j.latest_fundamental(_fund(t)), j.range_position(t.bars())))


@query("melted_statements", "S12", "sym period_end:date year:int quarter:int revenue:3 net_income:3",
       FIN_SQL + """, q AS (SELECT sym, make_date(year, 12, 31) AS period_end, year, 4 AS quarter, SUM(revenue) AS revenue, SUM(net_income) AS net_income FROM qs GROUP BY sym, year)""")
def _(t: Tables):
    d = F.col("l_shipdate").cast("date")
    money, disc, tax = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    years = [r.y for r in t.table("lineitem").select(F.year(d).alias("y")).distinct().orderBy("y").collect()]
    rows = t.table("lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sym"), F.year(d).alias("y"),
        F.explode(F.array(F.struct(F.lit("Total Revenue").alias("item"), (money * (1 - disc)).alias("x")),
                          F.struct(F.lit("Net Income Common").alias("item"), (money * (disc - tax)).alias("x")))).alias("v")).select("sym", "y", "v.*")
    wide = rows.groupBy("sym", "item").pivot("y", years).agg(F.sum("x").cast("double"))
    wide = wide.select("sym", "item", *[F.col(str(y)).alias(f"{y}-12-31") for y in years])
    return f.melt_statements(wide, {"revenue": ("Operating Revenue", "Total Revenue"), "net_income": ("Net Income", "Net Income Common")},
                             [f"{y}-12-31" for y in years])


# ---- scalar functions ---------------------------------------------------------------------------------

@query("tick_rounding", "P11", "sym d:date tick:0",
       B3 + """, tk AS (SELECT sym, d, CAST(close AS DOUBLE) AS close, CASE WHEN close < 200 THEN 1 WHEN close < 500 THEN 2 WHEN close < 2000 THEN 5 WHEN close < 5000 THEN 25 ELSE 50 END AS st FROM bars),
       q AS (SELECT sym, d, CAST(round_even(close / st, 0) * st AS DOUBLE) AS tick FROM tk)""")
def _(t: Tables):
    return t.brand_bars().select("sym", "d", prices.tick_round("close").alias("tick"))


@query("fibonacci_levels", "P12", "sym d:date r236:4 r382:4 r500:4 r618:4 r786:4 x1272:4 x1618:4",
       B3 + """, q AS (SELECT sym, d, high - 0.236 * (high - low) AS r236, high - 0.382 * (high - low) AS r382, high - 0.5 * (high - low) AS r500, high - 0.618 * (high - low) AS r618,
         high - 0.786 * (high - low) AS r786, high + 0.272 * (high - low) AS x1272, high + 0.618 * (high - low) AS x1618 FROM bars)""")
def _(t: Tables):
    return t.brand_bars().select("sym", "d", prices.fib("low", "high").alias("v")).select("sym", "d", "v.*")


@query("safe_numbers", "P1 P2 P3", "id:int clean:4 finite:4 ratio:6 share:6",
       """x AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS v, o_orderkey % 4 AS k, o_totalprice AS p FROM orders),
       q AS (SELECT id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE v END AS clean, CASE WHEN NOT (isnan(v) OR isinf(v)) THEN v END AS finite,
         CASE WHEN k > 0 THEN p / k END AS ratio, CASE WHEN k <> 0 THEN k / p * 100 ELSE 0 END AS share FROM x)""")
def _(t: Tables):
    k = F.col("o_orderkey") % 5
    v = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    x = t.table("orders").select(F.col("o_orderkey").alias("id"), v.alias("v"), (F.col("o_orderkey") % 4).alias("k"), F.col("o_totalprice").alias("p"))
    return x.select("id", numbers.num("v").alias("clean"), numbers.finite("v").alias("finite"), numbers.ratio("p", "k").alias("ratio"),
                    F.when(F.col("k") != 0, numbers.pct("k", "p")).otherwise(0.0).alias("share"))


@query("locale_numbers", "S2", "id:int n1:3 n2:3 n3:3",
       """q AS (SELECT o_orderkey AS id, floor(o_totalprice) AS n1, CAST(floor(o_totalprice) AS DOUBLE) + 0.5 AS n2, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS n3 FROM orders)""")
def _(t: Tables):
    # Dots group thousands: 12.345.678 and 12.345,5
    whole = F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit("."))
    half = F.concat(F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit(".")), F.lit(",5"))
    junk = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" - ")).otherwise(F.col("o_orderkey").cast("string"))
    return t.table("orders").select(F.col("o_orderkey").alias("id"), numbers.parse_number(whole).alias("n1"),
                                    numbers.parse_number(half).alias("n2"), numbers.parse_number(junk).alias("n3"))


@query("decorated_numbers", "S3", "id:int n1:int n2:int n3:int",
       "q AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS n1, CAST(floor(o_totalprice) AS BIGINT) AS n2, 0 AS n3 FROM orders)")
def _(t: Tables):
    whole = F.format_number(F.floor("o_totalprice"), 0)
    dotted = F.concat(F.lit("Rp "), F.replace(whole, F.lit(","), F.lit(".")), F.lit(",25"))
    return t.table("orders").select(
        F.col("o_orderkey").alias("id"), numbers.parse_int_loose(dotted).alias("n1"),
        numbers.parse_int_loose(F.concat(whole, F.lit(".25 lot"))).alias("n2"), numbers.parse_int_loose(F.lit("n/a")).alias("n3"))


@query("tolerant_dates", "S4", "id:int a:date b:date c:date",
       "q AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CAST(NULL AS DATE) AS c FROM orders)")
def _(t: Tables):
    d = F.col("o_orderdate")
    return t.table("orders").select(
        F.col("o_orderkey").alias("id"), dates.parse_date(F.date_format(d, "d/M/yyyy")).alias("a"),
        dates.parse_date(F.date_format(d, "yyyyMMdd"), dates.BROKER_DATE_FORMATS).alias("b"), dates.parse_date(F.lit("soon")).alias("c"))


@query("bounded_ratios", "S14", "sym as_of:date per:2 roe:2", FUND_SQL + ", q AS (SELECT sym, as_of, CASE WHEN per BETWEEN 2 AND 20 THEN per END AS per, CASE WHEN roe BETWEEN 0 AND 15 THEN roe END AS roe FROM fund)")
def _(t: Tables):
    return _fund(t).select("sym", "as_of", numbers.bounded("per", 2, 20).alias("per"), numbers.bounded("roe", 0, 15).alias("roe"))


@query("valid_symbols", "P5", "name ok:int n", "q AS (SELECT p_brand AS name, regexp_full_match(upper(trim(p_brand)), '[A-Z0-9][A-Z0-9.-]{0,14}') AS ok, COUNT(*) AS n FROM part GROUP BY 1 "
       "UNION ALL SELECT p_type, regexp_full_match(upper(trim(p_type)), '[A-Z0-9][A-Z0-9.-]{0,14}'), COUNT(*) FROM part GROUP BY 1)")
def _(t: Tables):
    p = t.table("part")
    names = p.select(F.col("p_brand").alias("name")).unionAll(p.select(F.col("p_type").alias("name")))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("ok", text.valid_symbol("name"))


@query("reason_normalisation", "P13", "reason n",
       "q AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'RSI14 oversold' ELSE 'Priority ' || o_orderpriority END AS reason, COUNT(*) AS n FROM orders GROUP BY 1)")
def _(t: Tables):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("RSI14 oversold ("), F.col("o_orderkey").cast("string"), F.lit(") "))).otherwise(
        F.concat(F.lit("Priority "), F.col("o_orderpriority")))
    return t.table("orders").groupBy(text.norm_reason(raw).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("symbol_search", "P15", "match_rank sym name",
       MASTER + """, r AS (SELECT sym, name, CASE WHEN sym = 'S1' THEN 0 WHEN sym LIKE 'S1%' THEN 1 WHEN sym LIKE '%S1%' THEN 2 WHEN upper(name) = 'S1' THEN 3 WHEN upper(name) LIKE 'S1%' THEN 4
         WHEN len(list_filter(regexp_split_to_array(upper(name), '[^A-Z0-9]+'), lambda x: starts_with(x, 'S1'))) > 0 THEN 5 WHEN upper(name) LIKE '%S1%' THEN 6 END AS match_rank FROM master),
       q AS (SELECT * FROM r WHERE match_rank IS NOT NULL ORDER BY match_rank, sym LIMIT 40)""")
def _(t: Tables):
    return text.search_symbols(t.master(), "s1", 40)


@query("next_sessions", "P8", "d:date s:int next_5:date wd_5:date",
       B1 + """, c AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS s, LEAD(d, 5) OVER (ORDER BY d) AS next_5 FROM (SELECT DISTINCT d FROM bars)),
       q AS (SELECT *, CASE WHEN isodow(d) <= 5 THEN d + 7 ELSE d + CAST(12 - isodow(d) AS INT) END AS wd_5 FROM c)""")
def _(t: Tables):
    cal = dates.nth_session(dates.market_calendar(t.bars()), 5)
    return cal.withColumn("wd_5", dates.add_weekdays("d", 5))


@query("latest_rows", "P6", "sym d:date close:4", B1 + ", q AS (SELECT * FROM bars QUALIFY d = MAX(d) OVER (PARTITION BY sym))")
def _(t: Tables):
    return dates.latest(t.bars(), per="sym")


@query("market_latest_rows", "P6", "sym d:date close:4", B1 + ", q AS (SELECT * FROM bars WHERE d = (SELECT MAX(d) FROM bars))")
def _(t: Tables):
    return dates.latest(t.bars())


@query("last_sessions_rows", "P7", "sym d:date close:4", B1 + ", q AS (SELECT * FROM bars WHERE d >= (SELECT MIN(d) FROM (SELECT DISTINCT d FROM bars ORDER BY d DESC LIMIT 60)))")
def _(t: Tables):
    bars = t.bars()
    return bars.filter(F.col("d") >= dates.sessions_cutoff(bars, 60))


@query("ad_hoc_select", "P19", "l_returnflag n:int", "q AS (SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1)")
def _(t: Tables):
    t.table("lineitem").createOrReplaceTempView("adhoc_lineitem")
    return text.run_select(t.spark, "SELECT l_returnflag, count(*) AS n FROM adhoc_lineitem GROUP BY l_returnflag;")
