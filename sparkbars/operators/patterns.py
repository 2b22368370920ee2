"""Candlestick events, rotation against the index, month seasonality, derived distances and anomaly proxies.

All per-symbol parts share the window of ``windows``: one exchange and one sort per chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import num
from . import scale
from .models import rate
from .windows import before, by_date, lagged, trail, with_rn

# ---- candlesticks ------------------------------------------------------------------------------

#: A bar's code is four letters: body (D doji, S small, N normal, L long), colour (w up, b down, e equal), long upper and
#: long lower shadow (1 or 0). A pattern is read by an expression over the codes of the last bars, oldest first, each
#: closed by a stroke, and by a condition on prices: o, h, l, c of this bar, u its usual body, o1 ... of the bar before, o2
#: ... of that before it.
#: ``fell`` and ``rose`` are about the five bars before the pattern. Name: (bars, codes, condition).
PATTERNS: dict[str, tuple[int, str, str]] = {
    "doji": (1, r"D.00", "h > l AND h - l < 2 * u"),
    "dragonfly_doji": (1, r"D.01", "h > l"),
    "gravestone_doji": (1, r"D.10", "h > l"),
    "long_legged_doji": (1, r"D.00", "h > l AND h - l >= 2 * u"),
    "white_marubozu": (1, r"Lw00", "h - c <= 0.05 * (h - l) AND o - l <= 0.05 * (h - l)"),
    "black_marubozu": (1, r"Lb00", "h - o <= 0.05 * (h - l) AND c - l <= 0.05 * (h - l)"),
    "hammer": (1, r"[SN].01", "fell"),
    "hanging_man": (1, r"[SN].01", "rose"),
    "inverted_hammer": (1, r"[SN].10", "fell"),
    "shooting_star": (1, r"[SN].10", "rose"),
    "bullish_engulfing": (2, r".b..\|[NL]w..", "fell AND o <= c1 AND c >= o1 AND c - o > o1 - c1"),
    "bearish_engulfing": (2, r".w..\|[NL]b..", "rose AND o >= c1 AND c <= o1 AND o - c > c1 - o1"),
    "bullish_harami": (2, r"Lb..\|[DS]...", "fell AND GREATEST(o, c) < o1 AND LEAST(o, c) > c1"),
    "bearish_harami": (2, r"Lw..\|[DS]...", "rose AND GREATEST(o, c) < c1 AND LEAST(o, c) > o1"),
    "piercing_line": (2, r"[NL]b..\|[NL]w..", "fell AND o < l1 AND c > (o1 + c1) / 2 AND c < o1"),
    "dark_cloud_cover": (2, r"[NL]w..\|[NL]b..", "rose AND o > h1 AND c < (o1 + c1) / 2 AND c > o1"),
    "tweezer_bottom": (2, r".b..\|.w..", "fell AND ABS(l - l1) <= 0.02 * (h1 - l1)"),
    "tweezer_top": (2, r".w..\|.b..", "rose AND ABS(h - h1) <= 0.02 * (h1 - l1)"),
    "morning_star": (3, r"Lb..\|[DS]...\|[NL]w..", "fell AND GREATEST(o1, c1) < c2 AND o > GREATEST(o1, c1) AND c > (o2 + c2) / 2"),
    "evening_star": (3, r"Lw..\|[DS]...\|[NL]b..", "rose AND LEAST(o1, c1) > c2 AND o < LEAST(o1, c1) AND c < (o2 + c2) / 2"),
    "three_white_soldiers": (3, r"[NL]w..\|[NL]w..\|[NL]w..", "c > c1 AND c1 > c2 AND o > o1 AND o < c1 AND o1 > o2 AND o1 < c2"),
    "three_black_crows": (3, r"[NL]b..\|[NL]b..\|[NL]b..", "c < c1 AND c1 < c2 AND o < o1 AND o > c1 AND o1 < o2 AND o1 > c2"),
    "three_inside_up": (3, r"Lb..\|[DS]...\|[SNL]w..", "fell AND GREATEST(o1, c1) < o2 AND LEAST(o1, c1) > c2 AND c > o2"),
    "three_inside_down": (3, r"Lw..\|[DS]...\|[SNL]b..", "rose AND GREATEST(o1, c1) < c2 AND LEAST(o1, c1) > o2 AND c < o2"),
    "three_outside_up": (3, r".b..\|[NL]w..\|.w..", "fell AND o1 <= c2 AND c1 >= o2 AND c1 - o1 > o2 - c2 AND c > c1"),
    "three_outside_down": (3, r".w..\|[NL]b..\|.b..", "rose AND o1 >= c2 AND c1 <= o2 AND o1 - c1 > c2 - o2 AND c < c1"),
}


def candle_codes(df: DataFrame, n: int = 10) -> DataFrame:
    """Adds ``code``, NULL until ``n`` earlier bars tell what a usual body is, and where a price is missing.

    Doji: a body of at most a tenth of the range; long: at least 1.3 times the mean body of the n bars before; small: at most
    half of it. A shadow is long from twice the body on (for a doji: from 0.6 of the range on). ``usual`` is the mean body."""
    o, h, l, c = (num(x) for x in ("open", "high", "low", "close"))
    body, span = F.abs(c - o), h - l
    usual = F.when(F.col("rn") > n, F.avg(body).over(before(n)))
    doji = body <= 0.1 * span
    kind = F.when(doji, "D").when(body >= 1.3 * usual, "L").when(body <= 0.5 * usual, "S").otherwise("N")
    colour = F.when(c > o, "w").when(c < o, "b").otherwise("e")
    least = F.when(doji, 0.6 * span).otherwise(2 * body)
    long = lambda shadow: F.when((shadow >= least) & (shadow > 0), "1").otherwise("0")
    code = F.concat(kind, colour, long(h - F.greatest(o, c)), long(F.least(o, c) - l))
    known = usual.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull() & o.isNotNull() & (h >= l)
    return with_rn(df).withColumns({"code": F.when(known, code), "usual": usual})


def candle_events(bars: DataFrame, n: int = 10) -> DataFrame:
    """``(sym, d, pattern)``: every pattern that ends on a bar; a bar may end several. One exchange and one sort."""
    df = candle_codes(bars, n).select("sym", "d", "open", "high", "low", "close", "code", F.col("usual").alias("u"))
    names = {"open": "o", "high": "h", "low": "l", "close": "c"}
    lags = {f"{short}{k}": lagged(name, k) for name, short in names.items() for k in (1, 2)}
    falls = {f"f{k}": lagged("close", k) - lagged("close", k + 5) for k in (1, 2, 3)}
    codes = {"code1": lagged("code", 1), "code2": lagged("code", 2)}
    df = df.withColumns({**lags, **falls, **codes}).withColumnsRenamed(names)
    found = []
    for name, (length, codes_, condition) in PATTERNS.items():
        seen = F.concat_ws("|", *[F.col(x) for x in ("code2", "code1", "code")[3 - length:]])
        whole = F.lit(True)
        for x in ("code2", "code1", "code")[3 - length:]:
            whole = whole & F.col(x).isNotNull()
        priced = F.expr(condition.replace("fell", f"f{length} < 0").replace("rose", f"f{length} > 0"))
        found.append(F.when(whole & seen.rlike(f"^{codes_}$") & priced, F.lit(name)))
    return df.select("sym", "d", F.explode(F.array_compact(F.array(*found))).alias("pattern"))


# ---- rotation ----------------------------------------------------------------------------------

def market_index(bars: DataFrame) -> DataFrame:
    """``(d, index_close)``: the market's turnover per share traded, one row a session."""
    return bars.groupBy("d").agg(F.try_divide(F.sum(num("value").cast("decimal(28,4)")).cast("double"), F.sum("volume")).alias("index_close"))


def rotation(bars: DataFrame, index: DataFrame | None = None, n: int = 20, ago: int = 5, band: float = 0.5) -> DataFrame:
    """Strength of each symbol against the index, its momentum, and the phase they make, on their common sessions.

    ``strength`` is the ratio to the index as a percentage of its own mean over n sessions, ``momentum`` the strength as a
    percentage of that ``ago`` sessions earlier. LEADING: both above 100; WEAKENING: strong and losing; LAGGING: both below;
    IMPROVING: weak and gaining. A phase changes only when strength and momentum both leave the ``band`` around
    100, so noise at the border does not flip it. ``phase_days`` counts its sessions so far, ``direction`` tells whether
    momentum rose. NULL until n + ago common sessions."""
    index = market_index(bars) if index is None else index
    df = with_rn(bars.select("sym", "d", "close").join(index.where("index_close > 0").select("d", "index_close"), "d").drop("rn"))
    df = df.withColumn("ratio", F.col("close") / F.col("index_close"))
    df = df.withColumn("strength", F.when(F.col("rn") >= n, F.try_divide(F.col("ratio"), F.avg("ratio").over(trail(n))) * 100))
    df = df.withColumn("momentum", F.try_divide(F.col("strength"), lagged("strength", ago)) * 100)
    clear = (F.abs(F.col("strength") - 100) >= band) & (F.abs(F.col("momentum") - 100) >= band)
    strong, gaining = F.col("strength") > 100, F.col("momentum") > 100
    raw = F.when(strong & gaining, "LEADING").when(strong, "WEAKENING").when(gaining, "IMPROVING").otherwise("LAGGING")
    df = df.withColumn("phase", F.last(F.when(clear, raw), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_new", F.when(F.col("phase").isNotNull() & ~F.col("phase").eqNullSafe(lagged("phase")), F.col("rn")))
    since = F.last("_new", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    move = F.col("momentum") - lagged("momentum")
    return df.withColumns({"phase_days": F.col("rn") - since + 1, "direction": F.when(move > 0, "UP").when(move < 0, "DOWN").when(move == 0, "FLAT")}).drop("_new")


# ---- seasonality -------------------------------------------------------------------------------

def month_returns(bars: DataFrame) -> DataFrame:
    """``(sym, month, month_return)``: daily returns compounded inside each calendar month, from the last close of the month
    before. A month after a month without bars has no return: its move is not that month's alone."""
    month = F.trunc("d", "month")
    ends = bars.filter(num("close") > 0).groupBy("sym", month.alias("month")).agg(F.max_by("close", "d").alias("close"))
    w = Window.partitionBy("sym").orderBy("month")
    follows = F.add_months(F.lag("month").over(w), 1) == F.col("month")
    return ends.withColumn("month_return", F.when(follows, F.col("close") / F.lag("close").over(w) - 1)).where("month_return is not null").select(
        "sym", "month", "month_return")


def seasonality(bars: DataFrame, shrink: float = 5.0) -> DataFrame:
    """Per symbol and month of the year: ``years``, the share of rising months with its 95% interval, the mean return, and
    the expectation, which is that mean drawn towards the market's mean of the same month as if ``shrink`` of its
    years had been seen."""
    returns = month_returns(bars).withColumn("month_of_year", F.month("month"))
    market = returns.groupBy("month_of_year").agg(F.avg("month_return").alias("market_mean"))
    per = returns.groupBy("sym", "month_of_year").agg(
        F.count(F.lit(1)).alias("years"), F.count_if(F.col("month_return") > 0).alias("rises"), F.avg("month_return").alias("mean_return"))
    out = per.withColumns(rate(F.col("rises"), F.col("years"), "rise_p")).join(market, "month_of_year")
    expected = (F.col("years") * F.col("mean_return") + shrink * F.col("market_mean")) / (F.col("years") + shrink)
    return out.withColumn("expected_return", expected)


# ---- derived table -----------------------------------------------------------------------------

def z_score(x: str, n: int) -> Column:
    """Distance of a value from the mean of its last n in sample deviations; NULL before n rows or without deviation."""
    return F.when(F.col("rn") >= n, F.try_divide(F.col(x) - F.avg(x).over(trail(n)), F.stddev_samp(x).over(trail(n))))


def derived_table(bars: DataFrame) -> DataFrame:
    """Per symbol and session: z-scores of the close over 5, 20 and 60 sessions and of the volume over 20, drawdown from the
    highest close of 20 and 60, commodity channel index over 20, and the channel of 20 highs and lows before this bar with
    the place of the close in it."""
    df = with_rn(bars.withColumn("_v", num("volume").cast("double")))
    drop = lambda n: F.when(F.col("rn") >= n, F.col("close") / F.max("close").over(trail(n)) - 1)
    df = df.withColumns({
        **{f"zscore_{n}": z_score("close", n) for n in (5, 20, 60)}, "volume_zscore_20": z_score("_v", 20),
        **{f"drawdown_{n}": drop(n) for n in (20, 60)}, "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
        "donchian_high": F.when(F.col("rn") > 20, F.max("high").over(before(20))), "donchian_low": F.when(F.col("rn") > 20, F.min("low").over(before(20)))})
    # The mean deviation is about the frame's own mean, which differs from row to row: the frame is gathered, 20 numbers.
    frame = F.collect_list("_tp").over(trail(20))
    mean = F.avg("_tp").over(trail(20))
    df = df.withColumns({"_frame": frame, "_mean": mean})
    deviation = F.expr("aggregate(_frame, 0D, (a, x) -> a + abs(x - _mean)) / 20")
    return df.withColumns({
        "cci_20": F.when(F.col("rn") >= 20, F.try_divide(F.col("_tp") - F.col("_mean"), 0.015 * deviation)),
        "donchian_place": F.try_divide(F.col("close") - F.col("donchian_low"), F.col("donchian_high") - F.col("donchian_low")),
    }).drop("_v", "_tp", "_frame", "_mean")


# ---- anomaly proxies ---------------------------------------------------------------------------

def with_places(df: DataFrame, group: list[str], wanted: dict) -> DataFrame:
    """``scale.group_places`` beside every row of its group, NULL groups included."""
    found = scale.group_places(df, group, wanted).withColumnsRenamed({g: f"_of_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return df.join(F.broadcast(found), same, "left").drop(*[f"_of_{g}" for g in group])


def middle(n: Column) -> Column:
    """Place of the median among n."""
    return (n - 1) * F.lit(0.5) + 1


def robust_distance(df: DataFrame, group: list[str], names: dict[str, str], also: dict | None = None) -> DataFrame:
    """Adds, for each value in ``names``, under its name there the distance from its group's median in normal-consistent median
    absolute deviations. Both medians are exact and no group is held whole; NULL where the value is or where half of the
    group is equal. Groups are few (dates): their medians go to every task and the rows stay where they are. ``also`` has
    places wanted besides, found in the same passes."""
    df = with_places(df, group, {**{f"_mid_{v}": (v, middle) for v in names}, **(also or {})})
    df = df.withColumns({f"_apart_{v}": F.abs(F.col(v) - F.col(f"_mid_{v}")) for v in names})
    df = with_places(df, group, {f"_mad_{v}": (f"_apart_{v}", middle) for v in names})
    df = df.withColumns({name: F.try_divide(0.6745 * (F.col(v) - F.col(f"_mid_{v}")), F.col(f"_mad_{v}")) for v, name in names.items()})
    return df.drop(*[f"_{kind}_{v}" for v in names for kind in ("mid", "apart", "mad")])


def anomaly_proxies(bars: DataFrame, bound: float = 3.5, share: float = 0.02) -> DataFrame:
    """Traded bars with robust distances, per date, of the (log) value per trade and of the range over the close, and flags:

    ``crossing_proxy``: value per trade beyond ``bound`` while the range is not wide - large blocks at one price;
    ``anomaly_proxy``: either distance beyond it; ``top_value``: the date's largest values per trade, ``share`` of its rows
    (at least one), ties included, by an exact cut."""
    df = bars.filter((num("volume") > 0) & (num("freq") > 0) & (num("close") > 0)).select(
        "sym", "d", F.log(F.col("value") / F.col("freq")).alias("trade_value"), (F.try_divide(F.col("high") - F.col("low"), F.col("close"))).alias("spread"))
    # A value is among the first k from above if it is not below the k-th.
    cut = lambda n: n - F.greatest(F.lit(1), F.floor(share * n)) + 1
    df = robust_distance(df, ["d"], {"trade_value": "value_z", "spread": "spread_z"}, {"_cut": ("trade_value", cut)})
    large, wide = F.coalesce(F.col("value_z") > bound, F.lit(False)), F.coalesce(F.col("spread_z") > bound, F.lit(False))
    calm = F.coalesce(F.col("spread_z") <= 0, F.lit(True))
    top = (F.col("trade_value") >= F.col("_cut")) & (F.abs("trade_value") < F.lit(float("inf")))
    return df.withColumns({"crossing_proxy": large & calm, "anomaly_proxy": large | wide, "top_value": F.coalesce(top, F.lit(False))}).drop("_cut")
