"""Market-wide roll-ups: day summary, breadth, rankings, cross-section, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import latest_date, sessions_cutoff
from ..functions.numbers import num
from . import scale
from . import windows as w

# Windows over dates alone hold at most one row per session.

def days():
    return Window.orderBy("d")



def day_aggregates() -> list[Column]:
    change, volume = F.col("change"), num("volume")
    flat = F.coalesce(change, F.lit(0.0)) == 0
    return [
        F.count(F.lit(1)).alias("listed"),
        F.count_if(volume > 0).alias("active"),
        F.count_if(change > 0).alias("advancers"),
        F.count_if(change < 0).alias("decliners"),
        F.count_if(flat).alias("unchanged"),
        F.count_if(flat & (volume > 0)).alias("unchanged_active"),
        F.count_if(volume <= 0).alias("inactive"),
        F.sum(num("volume")).cast("long").alias("volume"),
        F.sum(num("value").cast("decimal(28,2)")).cast("double").alias("value"),
        F.sum(num("freq")).cast("long").alias("freq"),
        F.sum(num("fbuy")).alias("fbuy"),
        F.sum(num("fsell")).alias("fsell"),
        F.sum(num("fbuy") - num("fsell")).alias("net"),
    ]


def market_day(bars: DataFrame) -> DataFrame:
    """One row per date: listed, active, advancing, declining, totals (bars with a price only)."""
    return bars.filter(F.col("close") > 0).groupBy("d").agg(*day_aggregates())


def breadth(bars: DataFrame, sessions: int | None = None) -> DataFrame:
    """Market days with breadth percent and the advance/decline line, which starts at 0."""
    if sessions:
        bars = bars.filter(F.col("d") >= sessions_cutoff(bars, sessions))
    day = market_day(bars)
    step = F.when(F.row_number().over(days()) == 1, 0).otherwise(F.col("advancers") - F.col("decliners"))
    day = day.withColumn("_step", step)
    line = F.sum("_step").over(days().rowsBetween(Window.unboundedPreceding, 0))
    moved = F.greatest(F.col("advancers") + F.col("decliners"), F.lit(1))
    return day.withColumns({"ad_line": line, "breadth_pct": F.col("advancers") / moved * 100}).drop("_step")


def breadth_score(tech: DataFrame) -> DataFrame:
    """Per date, from technicals: 40% advancers of active, 35% above SMA20, 25% above SMA50, with
    its label, the exact median return of active symbols, and new highs and lows."""
    active = num("volume") > 0
    # Advancers among all listed symbols over active ones, so the share may exceed that of active advancers.
    per = tech.groupBy("d").agg(
        F.count_if(F.col("change") > 0).alias("advancers"), F.count_if(active).alias("active"),
        F.count_if(active & F.col("sma20").isNotNull()).alias("n20"),
        F.count_if(active & (F.col("adj") > F.col("sma20"))).alias("above20"),
        F.count_if(active & F.col("sma50").isNotNull()).alias("n50"),
        F.count_if(active & (F.col("adj") > F.col("sma50"))).alias("above50"),
        F.count_if(F.col("breakout_20")).alias("new_high_20"), F.count_if(F.col("new_low_20")).alias("new_low_20"),
    )
    one = F.lit(1)
    per = per.withColumns({
        "advance_pct": F.col("advancers") / F.greatest("active", one) * 100,
        "above20_pct": F.col("above20") / F.greatest("n20", one) * 100,
        "above50_pct": F.col("above50") / F.greatest("n50", one) * 100,
    })
    score = F.col("advance_pct") * 0.4 + F.col("above20_pct") * 0.35 + F.col("above50_pct") * 0.25
    label = (F.when(score >= 65, "Strong").when(score >= 55, "Positive").when(score >= 45, "Neutral")
             .when(score >= 35, "Weak").otherwise("Very weak"))
    per = per.withColumns({"breadth_score": score, "breadth_label": label})
    moves = tech.filter(active & F.col("ret_1").isNotNull())
    median = scale.group_quantiles(moves, ["d"], "ret_1", {"median_return": 0.5})
    return per.join(median, "d", "left")


MOVER_COLUMNS = ("sym", "d", "close", "ret_1", "ret_20", "value", "volume_ratio", "net_20d", "score")


def movers(tech: DataFrame, k: int = 8) -> DataFrame:
    """Per date the top gainers and losers among liquid active symbols, and the most active ones."""
    liquid = (F.col("avg_value_20") >= 1e9) & (num("volume") > 0)
    lists = {
        "gainer": (liquid, -F.col("ret_1")),
        "loser": (liquid, F.col("ret_1")),
        "most_active": (F.lit(True), -F.col("value")),
    }
    return _ranked_lists(tech, lists, MOVER_COLUMNS, k)


def _ranked_lists(rows: DataFrame, lists: dict[str, tuple[Column, Column]], columns: tuple[str, ...], k: int) -> DataFrame:
    """Per date and list the first k rows that meet the list's condition, by its value, least first and NULLs last. A row
    names all its lists at once, so the rows are computed once, and one group-limited window serves all lists."""
    entries = F.array(*[F.when(cond, F.struct(F.lit(name).alias("list"), value.cast("double").alias("by"))) for name, (cond, value) in lists.items()])
    named = rows.withColumn("_e", F.explode(F.array_compact(entries))).select(*columns, "_e.list", F.col("_e.by").alias("_by"))
    return scale.top_k(named, ["d", "list"], [F.asc_nulls_last("_by"), F.asc("sym")], k).drop("_by")


def flow_rankings(tech: DataFrame, window: int = 20, k: int = 30, min_value: float = 1e9) -> DataFrame:
    """Per date: accumulation and distribution by net share of volume, unusual activity by the
    geometric mean of three activity ratios, most liquid; each with a price and flow context."""
    pct = f"net_volume_pct_{window}"
    ratios = [F.coalesce(c, F.lit(0.0)) for c in ("volume_ratio", "value_ratio", "freq_ratio")]
    all_positive = (ratios[0] > 0) & (ratios[1] > 0) & (ratios[2] > 0)
    up, inflow = num(f"ret_{window}") >= 0, num(f"net_{window}d") >= 0
    context = (F.when(up & inflow, "Price up + inflow").when(~up & inflow, "Price down + inflow")
               .when(up, "Price up + outflow").otherwise("Price down + outflow"))
    e = tech.filter(F.coalesce("avg_value_20", F.lit(0.0)) >= min_value).select(
        "sym", "d", "close", F.col(f"ret_{window}").alias("period_return"), F.col(f"net_{window}d").alias("net"),
        F.col(pct).alias("net_volume_pct"), F.col(f"consistency_{window}").alias("consistency"),
        F.col(f"net_value_{window}d").alias("net_value"), "avg_value_20",
        F.when(all_positive, F.pow(ratios[0] * ratios[1] * ratios[2], 1 / 3)).alias("activity_score"),
        context.alias("flow_context"),
    )
    lists = {
        "accumulation": (F.col("net_volume_pct") > 0, -F.col("net_volume_pct")),
        "distribution": (F.col("net_volume_pct") < 0, F.col("net_volume_pct")),
        "unusual_activity": (F.col("activity_score") >= 1.2, -F.col("activity_score")),
        "most_liquid": (F.lit(True), -F.col("avg_value_20")),
    }
    return _ranked_lists(e, lists, tuple(e.columns), k)


# ---- data profile --------------------------------------------------------------------------------

def profile(bars: DataFrame, master: DataFrame, log: DataFrame, today: Column) -> DataFrame:
    """One row: size, range, freshness, quality of the newest date, log summary. ``log`` has
    ``d, status, row_count, payload_sha256, updated_at``."""
    newest = latest_date(bars)
    total = bars.agg(
        F.count(F.lit(1)).alias("total_rows"), F.min("d").alias("date_from"), F.max("d").alias("date_to"),
        F.count_distinct("d").alias("trading_days"), F.count_distinct("sym").alias("tickers"))
    known = master.select("sym", F.lit(True).alias("_known")).distinct()
    day = bars.filter(F.col("d") == newest).join(known, "sym", "left")
    share = lambda cond: F.count_if(cond) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100
    quality = day.agg(
        F.count(F.lit(1)).alias("latest_rows"),
        share(num("volume") > 0).alias("active_pct"), share(num("open") > 0).alias("valid_open_pct"),
        share((num("high") > 0) & (num("low") > 0)).alias("valid_high_low_pct"),
        share(F.col("fbuy").isNotNull() & F.col("fsell").isNotNull()).alias("valid_foreign_pct"),
        share(F.col("_known").isNotNull()).alias("master_coverage_pct"))
    ok = F.col("status") == "success"
    logs = log.agg(
        F.count_if(ok).alias("success"), F.count_if(F.col("status") == "no_data").alias("no_data"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        (F.count_if(ok & F.col("payload_sha256").isNotNull()) / F.greatest(F.count_if(ok), F.lit(1)) * 100).alias("hashed_pct"),
        F.max(F.when(ok, F.col("d"))).alias("last_success"),
        F.max_by("status", F.struct("updated_at", "d")).alias("last_attempt_status"))
    # Three one-row frames are put side by side by position.
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(total).join(one(quality), "_one").join(one(logs), "_one").drop("_one")
    age = F.greatest(F.datediff(today, F.col("date_to")), F.lit(0))
    label = F.when(age <= 3, "current").when(age <= 7, "check").otherwise("sync needed")
    return out.withColumns({"age_days": age, "freshness": label})


def outside_master(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Symbols of the newest date that the master does not know."""
    return bars.filter(F.col("d") == latest_date(bars)).select("sym").join(master, "sym", "left_anti")


def quality_by_year(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.year("d").alias("year")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("sym").alias("symbols"), F.count_distinct("d").alias("sessions"),
        (F.count_if(F.coalesce("open", F.lit(0.0)) <= 0) / F.count(F.lit(1)) * 100).alias("null_open_pct"),
        (F.count_if(num("volume") <= 0) / F.count(F.lit(1)) * 100).alias("zero_volume_pct"),
        F.count_if(F.col("close").isNull() | (F.col("close") <= 0)).alias("bad_close"))


def active_symbols(bars: DataFrame, within: int = 60) -> DataFrame:
    """Symbols that traded in the last calendar days."""
    return bars.filter((F.col("d") > F.date_sub(latest_date(bars), within)) & (num("volume") > 0)).agg(
        F.count_distinct("sym").alias("active_symbols"))


def coverage(df: DataFrame, date: str, fields: tuple[str, ...], key: str = "sym", loss: str | None = None) -> DataFrame:
    """One row: range, dates, keys, non-null count per field, optional count of negative values."""
    extra = [F.count_if(F.col(loss) < 0).alias("loss_making")] if loss else []
    return df.agg(
        F.min(date).alias("date_from"), F.max(date).alias("date_to"), F.count_distinct(date).alias("dates"),
        F.count_distinct(key).alias("keys"), F.count(F.lit(1)).alias("row_count"),
        *[F.count(c).alias(f"has_{c}") for c in fields], *extra)


# ---- cross-section and regime --------------------------------------------------------------------

def xs_ranks(bars: DataFrame) -> DataFrame:
    """Percentile ranks per date (mean rank of ties over the non-null count) of the 1-, 5- and
    20-session returns and of traded value. A row is sent once for each measure."""
    x = {f"return_rank_{n}d": F.try_divide(F.col("close"), w.lagged("close", n)) - 1 for n in (1, 5, 20)} | {"value_rank": num("value")}
    ranked = scale.with_all_ranks(bars.select("d", "sym", *[c.alias(name) for name, c in x.items()]), ["d"], list(x))
    return ranked.select("d", "sym", *[((F.col(f"rank_{m}") + (F.col(f"ties_{m}") - 1) / 2) / F.col(f"n_{m}")).alias(m) for m in x])


def market_features(bars: DataFrame) -> DataFrame:
    """Market-level features per date from bars that traded: equal-weight returns, breadth, share
    above averages, new highs and lows, dispersion, index volatility, total value, regime."""
    df = w.with_rn(bars.filter((F.col("close") > 0) & (num("volume") > 0)))
    df = df.withColumns({"pc": F.try_divide(F.col("close"), w.lagged("close")) - 1, "_r5": F.try_divide(F.col("close"), w.lagged("close", 5)) - 1})
    df = w.with_means(df, {"sma20": ("close", 20), "sma50": ("close", 50)})
    df = df.withColumns({
        "_hi": w.full(F.max("close").over(w.trail(20)), 20), "_lo": w.full(F.min("close").over(w.trail(20)), 20)})
    c = F.col("close")
    share = lambda cond: F.avg(cond.cast("int"))  # noqa: E731 - NULL conditions stay out of the mean
    day = df.groupBy("d").agg(
        F.avg("pc").alias("ew"), share(F.col("pc") > 0).alias("market_breadth_1d"),
        share(c > F.col("sma20")).alias("pct_above_sma20"), share(c > F.col("sma50")).alias("pct_above_sma50"),
        share(F.col("_r5") > 0).alias("pct_stocks_up_5d"),
        share(c >= F.col("_hi")).alias("new_highs_20d"), share(c <= F.col("_lo")).alias("new_lows_20d"),
        (F.count_if(c >= F.col("_hi")) / (F.count_if(c <= F.col("_lo")) + 1)).alias("high_low_ratio"),
        F.when(F.count("pc") > 5, F.stddev_samp("pc")).alias("market_dispersion"),
        F.when(F.count("pc") > 0, F.count_if(F.col("pc") > 0) / (F.count_if(F.col("pc") < 0) + 1)).alias("advance_decline_ratio"),
        F.sum(num("value").cast("decimal(28,2)")).cast("double").alias("market_total_value"),
    )
    median = scale.group_quantiles(df, ["d"], "pc", {"market_median_return": 0.5})
    day = day.join(median, "d", "left").withColumn("k", F.row_number().over(days()))
    last = lambda n: days().rowsBetween(-(n - 1), 0)
    day = day.withColumns({
        **{f"market_return_{n}d": F.when(F.col("k") > n, F.avg("ew").over(last(n))) for n in (1, 5, 20, 60)},
        "market_hvol20": F.when(F.count("ew").over(last(20)) == 20, F.stddev_samp("ew").over(last(20)) * w.YEAR),
        "market_value_vs_ma20": F.when(F.col("k") >= 20, F.col("market_total_value") / (F.avg("market_total_value").over(last(20)) + 1)),
    })
    return with_regime(day).drop("ew", "k")


def with_regime(day: DataFrame) -> DataFrame:
    """Regime of the market and its four dummies."""
    above, ret = F.col("pct_above_sma20"), F.col("market_return_20d")
    regime = (
        F.when(F.col("market_hvol20") > 0.30, "HIGH_VOL")
        .when(above.isNull() | F.col("market_breadth_1d").isNull(), "NEUTRAL")
        .when((above > 0.60) & (ret > 0), "BULL_TREND").when(above > 0.45, "BULL_RANGE")
        .when((above < 0.30) & (ret < 0), "BEAR_TREND").when(above < 0.45, "BEAR_RANGE")
        .otherwise("NEUTRAL"))
    day = day.withColumn("market_regime", regime)
    flag = lambda *names: F.col("market_regime").isin(*names).cast("double")
    return day.withColumns({
        "regime_bullish": flag("BULL_TREND", "BULL_RANGE"), "regime_bearish": flag("BEAR_TREND", "BEAR_RANGE"),
        "regime_trending": flag("BULL_TREND", "BEAR_TREND"), "regime_volatile": flag("HIGH_VOL")})


def sector_features(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Per (symbol, date): mean 5-session return of its listing board, the share of the board below
    it, and the number of symbols listed on the board."""
    df = bars.filter((F.col("close") > 0) & (num("volume") > 0))
    df = df.withColumn("ret5", F.try_divide(F.col("close"), w.lagged("close", 5)) - 1).select("sym", "d", "ret5")
    boards = master.select("sym", "board")
    df = df.join(boards, "sym", "left").withColumn("board", F.coalesce("board", F.lit("Unknown")))
    size = boards.groupBy("board").agg(F.count_distinct("sym").alias("board_size"))
    mean = df.groupBy("d", "board").agg(F.avg("ret5").alias("sector_return_5d"))
    ranked = scale.with_ranks(df, ["d", "board"], "ret5")
    rank = F.when(F.col("n") > 1, (F.col("rank") - 1) / F.col("n"))
    return (
        ranked.join(mean, ["d", "board"], "left").join(size, "board", "left")
        .select("sym", "d", F.col("board").alias("sector"), "sector_return_5d", rank.alias("sector_rank"),
                F.col("board_size").alias("sector_n_stocks"))
    )
