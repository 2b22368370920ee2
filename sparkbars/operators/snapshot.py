"""Technical snapshot of every symbol and date, labels, condition score, screens, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import sessions_cutoff
from ..functions.numbers import num, ratio
from ..functions.prices import depth_imbalance, spread_pct
from . import windows as w

SNAPSHOT_SESSIONS = 261


def technicals(bars: DataFrame) -> DataFrame:
    """All snapshot metrics for every (symbol, date).

    Four levels over one exchange and sort: previous rows, frames over raw columns, frames over
    adjusted prices, frames over moves of adjusted prices."""
    df = w.reference_gap(bars.filter(num("close") > 0))
    close, ref = F.col("close"), F.col("ref")
    high = F.when(num("high") != 0, num("high")).otherwise(close)
    low = F.when(num("low") != 0, num("low")).otherwise(close)
    prev, bn = num("prev"), num("value") / 1e9
    gap_event = (ref > 0) & (F.col("c1") > 0) & (F.abs(ref / F.col("c1") - 1) >= 0.05)
    df = df.withColumns({
        "_high": high, "_low": low, "net_1d": num("fbuy") - num("fsell"), "_active": F.when(num("fbuy") + num("fsell") > 0, 1).otherwise(0),
        "_tr": F.when(ref > 0, F.greatest(high - low, F.abs(high - ref), F.abs(low - ref)) / ref * 100),
        "_turn": F.when(num("shares") > 0, num("volume") / num("shares")), "_idle": F.when(num("volume") > 0, 0.0).otherwise(1.0),
        "_impact": F.when((prev > 0) & (bn > 0), F.abs(close / prev - 1) * 100 / bn), "_gap_event": F.when(gap_event, 1).otherwise(0),
    })
    t, b20 = w.trail, w.before(20)
    n1 = F.col("net_1d")
    flow: dict[str, Column] = {}
    for n in (5, 20):
        active = F.sum("_active").over(t(n))
        positive, negative = F.sum(F.when(n1 > 0, 1).otherwise(0)).over(t(n)), F.sum(F.when(n1 < 0, 1).otherwise(0)).over(t(n))
        volume = F.sum(num("volume")).over(t(n))
        flow.update({
            f"net_{n}d": w.full(F.sum(n1).over(t(n)), n), f"net_value_{n}d": w.full(F.sum(n1 * close).over(t(n)), n),
            f"consistency_{n}": w.full(F.when(active > 0, positive / active * 100), n),
            f"pos_days_{n}": w.full(positive, n), f"neg_days_{n}": w.full(negative, n), f"flat_days_{n}": w.full(F.lit(n) - positive - negative, n),
            f"net_volume_pct_{n}": w.full(F.when(volume != 0, F.sum(n1).over(t(n)) / volume * 100), n)})
    df = df.withColumns({
        "cum_gap": F.product("gap").over(w.so_far()), "all_gap": F.product("gap").over(w.all_rows()), "gap_events": F.sum("_gap_event").over(w.so_far()),
        "atr14_pct": F.when(F.count("_tr").over(t(14)) == 14, F.avg("_tr").over(t(14))),
        **{f"avg_{c}_20": w.full(F.avg(num(c)).over(b20), 21) for c in ("volume", "value", "freq")},
        "_avg_turn": F.when(F.count("_turn").over(b20) == 20, F.avg("_turn").over(b20)), "_same_shares": w.same_shares(b20),
        "price_impact_20": w.full(F.avg("_impact").over(t(20)), 20), "active_pct_20": w.full((1 - F.avg("_idle").over(t(20))) * 100, 20), **flow,
    })
    scale = F.col("all_gap") / F.col("cum_gap")
    df = df.withColumns({
        "adj": close * scale, "adj_high": F.col("_high") * scale, "adj_low": F.col("_low") * scale,
        **{f"{c}_ratio": ratio(num(c), f"avg_{c}_20") for c in ("volume", "value", "freq")},
        "turnover_ratio": w.turnover_ratio("_turn", "_avg_turn", "_same_shares", "avg_volume_20"), "turnover_pct": F.col("_turn") * 100,
    })
    df = df.withColumn("confirmation_ratio", F.coalesce("turnover_ratio", "volume_ratio"))
    df = df.drop("_high", "_low", "_active", "_tr", "_turn", "_idle", "_impact", "_gap_event", "_avg_turn", "_same_shares", "cum_gap", "all_gap", "gap", "c1")
    adj, base = F.col("adj"), {n: w.lagged("adj", n) for n in (1, 5, 20, 60)}
    hi, lo = F.max("adj_high").over(b20), F.min("adj_low").over(b20)
    enough = F.col("rn") > 20
    df = df.withColumns({
        "diff": adj - base[1], "log_ret": F.when((adj > 0) & (base[1] > 0), F.log(adj / base[1])),
        **{f"ret_{n}": F.when(base[n] > 0, (adj / base[n] - 1) * 100) for n in base},
        "high_20": hi, "low_20": lo, "breakout_20": F.coalesce(enough & (adj > hi), F.lit(False)), "new_low_20": F.coalesce(enough & (adj < lo), F.lit(False)),
        "sma20": w.sma("adj", 20), "_sum10": F.sum("adj").over(t(10)),
    })
    total50 = total200 = F.col("_sum10")
    for k in range(10, 200, 10):
        total200 = total200 + F.lag("_sum10", k).over(w.by_date())
        total50 = total50 + F.lag("_sum10", k).over(w.by_date()) if k < 50 else total50
    vol = F.when(F.count("log_ret").over(t(20)) >= 2, F.stddev_pop("log_ret").over(t(20)) * (w.YEAR * 100))
    df = df.withColumns({"sma50": w.full(total50 / 50, 50), "sma200": w.full(total200 / 200, 200), "rsi14": w.rsi_cutler(14), "volatility20": w.full(vol, 21)})
    df = df.withColumns({f"dist_sma{n}": F.when(F.col(f"sma{n}") != 0, (adj / F.col(f"sma{n}") - 1) * 100) for n in (20, 50, 200)})
    df = w.with_max_drawdown(df.drop("diff", "log_ret", "_sum10"), "max_drawdown60", 60)
    if {"bid", "offer"} <= set(df.columns):
        df = df.withColumn("spread_pct", spread_pct("bid", "offer"))
    if {"bid_vol", "offer_vol"} <= set(df.columns):
        df = df.withColumn("depth_imbalance", depth_imbalance("bid_vol", "offer_vol"))
    return with_quality(with_tags(with_score(with_labels(df))))


def snapshot(bars: DataFrame, sessions: int = SNAPSHOT_SESSIONS, per: str = "market") -> DataFrame:
    """The newest row of each symbol from its trailing sessions. ``per="market"`` keeps symbols
    that have a bar on the market's newest date and cuts history by market sessions; ``per="sym"``
    takes each symbol's own newest bar over its whole history."""
    if per == "market":
        bars = bars.filter(F.col("d") >= sessions_cutoff(bars, sessions))
    df = technicals(bars)
    newest = F.max("d").over(w.all_rows())
    df = df.withColumn("_newest", newest).filter(F.col("d") == F.col("_newest")).drop("_newest")
    # The market's newest date is read off the bars, not off the computed snapshot.
    return df.filter(F.col("d") == bars.agg(F.max("d")).scalar()) if per == "market" else df


def with_labels(df: DataFrame) -> DataFrame:
    """Trend, momentum and liquidity labels."""
    c, s20, s50, rsi = F.col("adj"), F.col("sma20"), F.col("sma50"), F.col("rsi14")
    value = F.coalesce(F.col("avg_value_20"), F.lit(0.0))
    return df.withColumns({
        "trend": F.when((c > s20) & (s20 > s50), "Uptrend").when((c < s20) & (s20 < s50), "Downtrend").otherwise("Sideways"),
        "momentum": F.when(rsi.isNull(), "Insufficient data").when(rsi >= 70, "Overbought").when(rsi <= 30, "Oversold")
        .when(rsi >= 50, "Positive").otherwise("Negative"),
        "liquidity": F.when(value >= 5e10, "High").when(value >= 1e10, "Medium").otherwise("Low"),
    })


# Weights of the condition score; they sum to 100.
SCORE_WEIGHTS = {
    "price_above_sma20": 20,
    "sma20_above_sma50": 20,
    "return_20d_positive": 15,
    "return_1d_positive": 10,
    "volume_confirmation": 10,
    "foreign_net_positive": 15,
    "rsi_positive_zone": 10,
}
MIN_SCORE_SESSIONS = 50


def score_tests() -> dict[str, Column]:
    """Each test is NULL where its inputs are missing."""
    return {
        "price_above_sma20": F.col("adj") > F.col("sma20"),
        "sma20_above_sma50": F.col("sma20") > F.col("sma50"),
        "return_20d_positive": F.col("ret_20") > 0,
        "return_1d_positive": F.col("ret_1") > 0,
        "volume_confirmation": F.when(F.col("confirmation_ratio").isNotNull() & F.col("ret_1").isNotNull(),
                                      (F.col("confirmation_ratio") >= 1.2) & (F.col("ret_1") > 0)),
        "foreign_net_positive": F.col("net_20d") > 0,
        "rsi_positive_zone": F.col("rsi14").between(50, 70),
    }


def with_score(df: DataFrame) -> DataFrame:
    """Condition score 0-100, its components and the share of weight that could be tested."""
    tests = score_tests()
    zero = F.lit(0)
    points = sum((F.when(t, SCORE_WEIGHTS[k]).otherwise(0) for k, t in tests.items()), zero)
    covered = sum((F.when(t.isNotNull(), SCORE_WEIGHTS[k]).otherwise(0) for k, t in tests.items()), zero)
    parts = F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(SCORE_WEIGHTS[k]).alias("weight"), t.isNotNull().alias("available"),
                 F.coalesce(t, F.lit(False)).alias("passed"), F.when(t, SCORE_WEIGHTS[k]).otherwise(0).alias("points"))
        for k, t in tests.items()])
    return df.withColumns({
        "score": F.when(F.col("rn") >= MIN_SCORE_SESSIONS, points.cast("double")),
        "score_coverage": covered,
        "score_parts": parts,
    })


def keep(*items: tuple[Column, str | Column]) -> Column:
    """The texts whose condition holds, in order."""
    texts = F.array(*[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in items])
    return F.filter(texts, lambda x: x.isNotNull())


def with_tags(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", keep(
        (F.col("breakout_20"), "Breakout 20D"),
        (F.col("confirmation_ratio") >= 1.5, "Activity spike"),
        (F.col("value_ratio") >= 1.5, "Value spike"),
        ((F.col("net_20d") > 0) & (F.col("consistency_20") >= 60), "Foreign accumulation"),
        (F.col("rsi14") <= 30, "Oversold"),
    ))


COVERAGE_FIELDS = ("ret_20", "ret_60", "sma20", "sma50", "sma200", "rsi14", "atr14_pct", "volatility20", "net_20d")


def with_quality(df: DataFrame) -> DataFrame:
    present = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in COVERAGE_FIELDS), F.lit(0))
    return df.withColumns({
        "indicator_coverage": present / len(COVERAGE_FIELDS) * 100,
        "quality_flags": keep(
            (num("volume") <= 0, "No trade in the latest session"),
            (F.col("rn") < 200, "History too short for SMA200"),
            (F.col("gap_events") > 0, F.concat(F.col("gap_events").cast("string"), F.lit(" reference price adjustments applied"))),
            (F.coalesce(F.col("active_pct_20"), F.lit(0.0)) < 60, "Trading is not consistent"),
        ),
    })


def presets() -> dict[str, Column]:
    """Named screener conditions over snapshot columns; missing inputs fail the test."""
    c = F.col
    value = F.coalesce(c("avg_value_20"), F.lit(0.0))
    return {
        "all": F.lit(True),
        "momentum": (c("adj") > c("sma20")) & (c("sma20") > c("sma50")) & c("rsi14").between(50, 70)
        & (c("ret_20") > 0) & (value >= 1e10),
        "breakout": c("breakout_20") & (c("confirmation_ratio") >= 1.5) & (value >= 1e10),
        "volume": (c("volume_ratio") >= 1.5) & (c("value_ratio") >= 1.5) & (c("freq_ratio") >= 1.5),
        "foreign": (c("net_volume_pct_20") > 0) & (c("consistency_20") >= 60) & (value >= 1e10),
        "oversold": (c("rsi14") <= 30) & (value >= 1e9),
        "liquid": (value >= 5e10) & (c("active_pct_20") >= 90),
    }


def screen(snap: DataFrame, preset: str | None = None, search: str | None = None, trend: str | None = None,
           liquidity: str | None = None, sort: str = "score", descending: bool = True) -> DataFrame:
    """Filtered and sorted snapshot; missing values last, ties by symbol."""
    out = snap
    if preset:
        out = out.filter(presets()[preset])
    if search:
        q = search.strip().upper()
        hit = F.upper("sym").contains(q)
        out = out.filter(hit | F.upper("name").contains(q) if "name" in out.columns else hit)
    if trend:
        out = out.filter(F.col("trend") == trend)
    if liquidity:
        out = out.filter(F.col("liquidity") == liquidity)
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return out.orderBy(order, "sym")


def stock_history(bars: DataFrame, n: int | None = None) -> DataFrame:
    """Every symbol's history with adjusted prices, averages, RSI, official return and an
    adjustment flag; ``n`` keeps the last n rows per symbol."""
    df = w.with_sma(w.back_adjust(bars.filter(num("close") > 0)), (20, 50))
    df = w.with_diff(df).withColumn("rsi14", w.rsi_cutler(14))
    df = df.withColumns({
        "official_return": F.when(F.col("ref") > 0, (F.col("close") / F.col("ref") - 1) * 100),
        "is_adjusted": F.abs(F.col("adj") / F.col("close") - 1) > 1e-9,
    })
    df = w.levels(df)
    if n is None:
        return df
    total = F.count(F.lit(1)).over(w.all_rows())
    return df.withColumn("_n", total).filter(F.col("rn") > F.col("_n") - n).drop("_n")


def watch_signal(rsi: Column, trend: Column, change: Column) -> Column:
    """Quick verdict from RSI, trend and the day's change."""
    return (
        F.when(rsi.isNull(), "-")
        .when((rsi <= 30) & (trend == "Uptrend"), "Strong Buy")
        .when((rsi <= 40) & trend.isin("Uptrend", "Sideways"), "Buy")
        .when((rsi >= 70) & (trend == "Downtrend"), "Strong Sell")
        .when((rsi >= 65) & (trend == "Downtrend"), "Sell")
        .when((trend == "Uptrend") & (change >= 0), "Accumulate")
        .when((trend == "Downtrend") & (change < 0), "Caution")
        .otherwise("Neutral")
    )


def watchlist(bars: DataFrame, codes: DataFrame) -> DataFrame:
    """A requested list of symbols (``pos``, ``sym``) in its own order; unknown ones stay with NULLs.
    Raw prices; the trend needs 20 sessions, the RSI and the ATR 15."""
    mine = bars.join(codes.select("sym").distinct(), "sym", "left_semi")
    df = w.with_diff(w.with_rn(mine), "close")
    df = w.with_sma(df, (20, 50), "close").withColumns({
        "rsi14": w.rsi_cutler(14, still=100.0), "atr": w.full(w.atr_close(14), 15),
        "change_pct": F.when(num("prev") > 0, F.col("change") / F.col("prev") * 100).otherwise(F.lit(0.0)),
        "vol_avg20": F.avg("volume").over(w.before(20)),
        "sparkline": w.sparkline(30),
    })
    df = w.with_extremes(df, {"high_52w": ("max", "close", 252), "low_52w": ("min", "close", 252)})
    newest = F.max("d").over(w.all_rows())
    df = df.withColumn("_newest", newest).filter(F.col("d") == F.col("_newest"))
    c, atr, s20, s50 = F.col("close"), F.col("atr"), F.col("sma20"), F.col("sma50")
    trend = (
        F.when((c > s20) & (c > s50), "Uptrend").when((c < s20) & (c < s50), "Downtrend")
        .when(s20.isNotNull() & s50.isNull(), F.when(c > s20, "Uptrend").otherwise("Downtrend"))
        .otherwise("Sideways")
    )
    df = df.withColumn("trend", trend).select(
        "sym", "d", "close", "change_pct", "rsi14", "atr", "trend", "sma20", "sma50", "high_52w", "low_52w",
        "vol_avg20", F.when(F.col("vol_avg20") > 0, F.col("volume") / F.col("vol_avg20")).alias("vol_ratio"),
        watch_signal(F.col("rsi14"), F.col("trend"), F.col("change_pct")).alias("signal"),
        (c + 2.5 * atr).alias("take_profit"), (c - 1.5 * atr).alias("stop_loss"), "sparkline",
    )
    return codes.join(df, "sym", "left").orderBy("pos")


def portfolio(positions: DataFrame, current: DataFrame) -> DataFrame:
    """Holdings (sym, buy_price, quantity, target) against current prices."""
    j = positions.join(current, "sym", "left")
    gain = F.col("close") - F.col("buy_price")
    return j.withColumns({
        "pl_pct": F.when(F.col("buy_price") > 0, gain / F.col("buy_price") * 100),
        "pl_nominal": F.when(F.col("buy_price") > 0, gain * F.col("quantity")),
        "to_target_pct": F.when(F.col("close") > 0, (F.col("target") - F.col("close")) / F.col("close") * 100),
    })


def portfolio_summary(held: DataFrame) -> DataFrame:
    """Counts by signal side and direction, mean change and total profit (one row)."""
    signal, change = F.col("signal"), F.coalesce("change_pct", F.lit(0.0))
    return held.agg(
        F.count(F.lit(1)).alias("positions"),
        F.count_if(signal.isin("Strong Buy", "Buy", "Accumulate")).alias("buys"),
        F.count_if(signal.isin("Strong Sell", "Sell", "Caution")).alias("sells"),
        F.count_if(change > 0).alias("up"), F.count_if(change < 0).alias("down"),
        F.avg(change).alias("mean_change"), F.sum("pl_nominal").alias("pl_total"),
    )


def signature(bars: DataFrame) -> DataFrame:
    """What identifies a state of the data: newest date, its row count, total rows."""
    newest = bars.agg(F.max("d")).scalar()
    return bars.agg(F.max("d").alias("newest"), F.count_if(F.col("d") == newest).alias("rows_newest"),
                    F.count(F.lit(1)).alias("row_count"))
