"""Per-symbol window operators.

All of them share one window specification (partition by symbol, order by date), so that a
chain of them costs one exchange and one sort. A bar table holds one row per (symbol, session):
each window group is bounded by the number of sessions, not by the size of the table.

Functions take a bars frame and return it with more columns, for every (symbol, date).
"N-full" means NULL until N rows exist; ``rn`` (1-based row number) is the guard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import col, num, ratio

YEAR = 252 ** 0.5


def by_date():
    """A symbol's rows in date order. A function, as a window needs a live session."""
    return Window.partitionBy("sym").orderBy("d")


def all_rows():
    return by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far():
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def trail(n: int):
    """The last n rows, this one included."""
    return by_date().rowsBetween(-(n - 1), 0)


def before(n: int):
    """The n rows before this one."""
    return by_date().rowsBetween(-n, -1)


def full(x: Column, n: int) -> Column:
    return F.when(F.col("rn") >= n, x)


def with_rn(df: DataFrame) -> DataFrame:
    return df if "rn" in df.columns else df.withColumn("rn", F.row_number().over(by_date()))


def lagged(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_date())


# ---- wide windows in two levels -------------------------------------------------------------
#
# A sliding frame is re-read for every row. For wide windows the frame is built from short ones:
# the extreme of 252 rows is the extreme of thirteen lagged 20-row extremes, the sum of 200 rows
# is the sum of twenty lagged 10-row sums. That costs about 33 (30) steps a row instead of 252 (200).

SHORT = 20


def with_extremes(df: DataFrame, wanted: dict[str, tuple[str, str, int]]) -> DataFrame:
    """``wanted`` maps a new column to ("max" or "min", column, rows). Fewer rows at the start of
    a series give the extreme of what is there."""
    agg = {"max": F.max, "min": F.min}
    merge = {"max": F.greatest, "min": F.least}
    bases = sorted({(kind, x) for kind, x, n in wanted.values() if n > 2 * SHORT})
    df = df.withColumns({f"_{kind}_{x}": agg[kind](x).over(trail(SHORT)) for kind, x in bases}) if bases else df
    out: dict[str, Column] = {}
    for name, (kind, x, n) in wanted.items():
        if n <= 2 * SHORT:
            out[name] = agg[kind](x).over(trail(n))
            continue
        base = F.col(f"_{kind}_{x}")
        offsets = list(range(SHORT, n - SHORT, SHORT)) + [n - SHORT]
        out[name] = merge[kind](base, *[F.lag(base, k).over(by_date()) for k in offsets])
    df = df.withColumns(out)
    return df.drop(*[f"_{kind}_{x}" for kind, x in bases])


def with_means(df: DataFrame, wanted: dict[str, tuple[str, int]], step: int = 10) -> DataFrame:
    """``wanted`` maps a new column to (column, rows): N-full means."""
    df = with_rn(df)
    wide = {name: (x, n) for name, (x, n) in wanted.items() if n >= 5 * step and n % step == 0}
    bases = sorted({x for x, _ in wide.values()})
    df = df.withColumns({f"_sum_{x}": F.sum(x).over(trail(step)) for x in bases}) if bases else df
    out: dict[str, Column] = {}
    for name, (x, n) in wanted.items():
        if name not in wide:
            out[name] = full(F.avg(x).over(trail(n)), n)
            continue
        base = F.col(f"_sum_{x}")
        total = base
        for k in range(step, n, step):
            total = total + F.lag(base, k).over(by_date())
        out[name] = full(total / n, n)
    return df.withColumns(out).drop(*[f"_sum_{x}" for x in bases])


def count_in_days(flag: str, days: int) -> Column:
    """Sum of a 0/1 column over the last calendar days, today included: the total so far less that before those days. Both frames
    only grow, so a row is read twice however many sessions the days hold."""
    earlier = F.expr(f"sum({flag}) over (partition by sym order by d range between unbounded preceding and {days + 1} preceding)")
    return F.coalesce(F.sum(flag).over(so_far()), F.lit(0)) - F.coalesce(earlier, F.lit(0))


# ---- back-adjusted prices ------------------------------------------------------------------

def reference_gap(bars: DataFrame) -> DataFrame:
    """``c1`` previous raw close, ``ref`` official reference (else c1), ``gap`` = ref / c1."""
    df = with_rn(bars).withColumn("c1", lagged(num("close")))
    ref = F.when(num("prev") > 0, F.col("prev")).otherwise(F.col("c1"))
    ok = (F.col("c1") > 0) & (ref > 0) & (num("close") > 0)
    return df.withColumns({"ref": ref, "gap": F.when(ok, ref / F.col("c1")).otherwise(F.lit(1.0))})


def back_adjust(bars: DataFrame) -> DataFrame:
    """``adj`` close (and high, low, open) made continuous across reference gaps, anchored at the
    newest close: close_i times the product of all later gaps. One forward cumulative product
    (linear per symbol), divided into its last value."""
    df = bars if "gap" in bars.columns else reference_gap(bars)
    df = df.withColumns({
        "cum_gap": F.product("gap").over(so_far()),
        "all_gap": F.product("gap").over(all_rows()),
    })
    scale = F.col("all_gap") / F.col("cum_gap")
    close = num("close")
    high = F.when(num("high") != 0, num("high")).otherwise(close)
    low = F.when(num("low") != 0, num("low")).otherwise(close)
    df = df.withColumns({"adj": close * scale, "adj_high": high * scale, "adj_low": low * scale})
    return df.withColumn("adj_open", num("open") * scale) if "open" in bars.columns else df


def gap_events(bars: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Bars whose reference differs from the previous raw close by the threshold or more."""
    df = reference_gap(bars)
    gap = F.col("ref") / F.col("c1") - 1
    return (
        df.filter((F.col("ref") > 0) & (F.col("c1") > 0) & (F.abs(gap) >= threshold))
        .select("sym", "d", "c1", "ref", (gap * 100).alias("gap_pct"))
    )


def gap_summary(bars: DataFrame, threshold: float = 0.05, last: int = 5) -> DataFrame:
    """Number of gap events per symbol and the dates of the last few."""
    events = gap_events(bars, threshold)
    newest = Window.partitionBy("sym").orderBy(F.desc("d"))
    events = events.withColumn("k", F.row_number().over(newest))
    return events.groupBy("sym").agg(
        F.count("*").alias("events"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= last, F.col("d").cast("string")))).alias("last_dates"),
    )


# ---- returns, averages, oscillators without recurrence -----------------------------------------

def returns(df: DataFrame, lags: Sequence[int] = (1, 5, 20, 60), x: str = "adj", prefix: str = "ret_") -> DataFrame:
    base = {n: lagged(x, n) for n in lags}
    return df.withColumns({
        f"{prefix}{n}": F.when(base[n] > 0, (F.col(x) / base[n] - 1) * 100) for n in lags
    })


def sma(x: Column | str, n: int) -> Column:
    return full(F.avg(col(x)).over(trail(n)), n)


def with_sma(df: DataFrame, ns: Sequence[int] = (20, 50, 200), x: str = "adj") -> DataFrame:
    df = with_means(df, {f"sma{n}": (x, n) for n in ns})
    return df.withColumns({
        f"dist_sma{n}": F.when(F.col(f"sma{n}") != 0, (F.col(x) / F.col(f"sma{n}") - 1) * 100) for n in ns
    })


def with_diff(df: DataFrame, x: str = "adj") -> DataFrame:
    return df.withColumn("diff", F.col(x) - lagged(x))


def rsi_cutler(n: int = 14, diff: str = "diff", still: float = 50.0) -> Column:
    """RSI from simple means of gains and losses; no movement at all is ``still``, no loss is 100."""
    gains = F.sum(F.greatest(F.col(diff), F.lit(0.0))).over(trail(n)) / n
    losses = F.sum(F.greatest(-F.col(diff), F.lit(0.0))).over(trail(n)) / n
    value = (
        F.when((gains == 0) & (losses == 0), F.lit(still))
        .when(losses == 0, F.lit(100.0))
        .otherwise(100 - 100 / (1 + gains / losses))
    )
    return full(value, n + 1)


def atr_pct(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range in percent of the reference price; all n references must be positive."""
    df = df if "ref" in df.columns else reference_gap(df)
    close = num("close")
    high = F.when(num("high") != 0, num("high")).otherwise(close)
    low = F.when(num("low") != 0, num("low")).otherwise(close)
    ref = F.col("ref")
    tr = F.greatest(high - low, F.abs(high - ref), F.abs(low - ref)) / ref * 100
    df = df.withColumn("tr_pct", F.when(ref > 0, tr))
    frame = trail(n)
    return df.withColumn(f"atr{n}_pct", F.when(F.count("tr_pct").over(frame) == n, F.avg("tr_pct").over(frame)))


def atr_close(n: int = 14, diff: str = "diff") -> Column:
    """Mean absolute close-to-close move."""
    return F.avg(F.abs(F.col(diff))).over(trail(n))


def vol_log(df: DataFrame, n: int = 20, x: str = "adj") -> DataFrame:
    """Annualised population deviation of n log returns, in percent; at least two returns."""
    prev = lagged(x)
    df = df.withColumn("log_ret", F.when((F.col(x) > 0) & (prev > 0), F.log(F.col(x) / prev)))
    frame = trail(n)
    value = F.when(F.count("log_ret").over(frame) >= 2, F.stddev_pop("log_ret").over(frame) * (YEAR * 100))
    return df.withColumn(f"volatility{n}", full(value, n + 1))


def with_pct_change(df: DataFrame, x: str = "close") -> DataFrame:
    return df.withColumn("pc", F.try_divide(F.col(x), lagged(x)) - 1)


def hvol(n: int) -> Column:
    return full(F.stddev_samp("pc").over(trail(n)) * YEAR, n + 1)


def with_hvols(df: DataFrame, n: int = 20, blocks: int = 3) -> DataFrame:
    """``hvol`` of n rows and of ``blocks`` times as many. The wide one is put together from the counts, means and squared
    deviations of lagged blocks of n rows, so a row is read n times and not (1 + blocks) * n times."""
    frame, zero = trail(n), F.lit(0.0)
    df = df.withColumns({"_sd": F.stddev_samp("pc").over(frame), "_k": F.count("pc").over(frame), "_m": F.coalesce(F.avg("pc").over(frame), zero)})
    df = df.withColumn("_q", F.coalesce(F.col("_sd") * F.col("_sd") * (F.col("_k") - 1), zero))
    parts = [{c: F.coalesce(lagged(c, i * n) if i else F.col(c), F.lit(0)) for c in ("_k", "_m", "_q")} for i in range(blocks)]
    df = df.withColumns({"_n": sum((p["_k"] for p in parts), F.lit(0)), "_sum": sum((p["_k"] * p["_m"] for p in parts), zero)})
    df = df.withColumn("_mean", F.try_divide("_sum", F.col("_n")))
    squares = sum((p["_q"] + p["_k"] * (p["_m"] - F.col("_mean")) * (p["_m"] - F.col("_mean")) for p in parts), zero)
    wide = F.when(F.col("_n") > 1, F.sqrt(squares / (F.col("_n") - 1))) * YEAR
    df = df.withColumns({f"hvol{n}": full(F.col("_sd") * YEAR, n + 1), f"hvol{n * blocks}": full(wide, n * blocks + 1)})
    return df.drop("_sd", "_k", "_m", "_q", "_n", "_sum", "_mean")


def downside_vol(n: int) -> Column:
    """Rising and undefined days count as zero."""
    down = F.when(F.col("pc") < 0, F.col("pc")).otherwise(F.lit(0.0))
    return full(F.stddev_samp(down).over(trail(n)) * YEAR, n + 1)


def hvol_percentile(df: DataFrame, n: int = 20, look: int = 60) -> DataFrame:
    """Share of the last ``look`` volatilities that are not above today's; needs ten of them."""
    name = f"hvol{n}"
    df = df if name in df.columns else df.withColumn(name, hvol(n))
    frame = trail(look)
    seen = F.collect_list(name).over(frame)
    df = df.withColumn("_seen", seen)
    now = F.col(name)
    share = F.size(F.filter("_seen", lambda v: v <= now)) / F.size("_seen")
    value = F.when((F.size("_seen") >= 10) & now.isNotNull() & (F.col("rn") >= look), share)
    return df.withColumn("hvol_pctile", value).drop("_seen")


def with_max_drawdown(df: DataFrame, name: str, n: int = 60, x: str = "adj") -> DataFrame:
    """Worst fall of a price (not below zero) from the running peak of the trailing window, in percent (needs two rows). The fall in two
    successive blocks is the worst of either's and of the second's low below the first's peak, so n rows are put together
    from five times fewer blocks at each level."""
    df, zero = with_rn(df), F.lit(0.0)
    fall = lambda peak, low: F.when(peak > 0, low / peak - 1)

    def joined(parts: list[tuple[Column, Column, Column]]) -> dict[str, Column]:
        """Peak, low and fall of blocks in order, oldest first; a block before the first row is NULL, and so passed over."""
        falls = [d for _, _, d in parts]
        for i in range(1, len(parts)):
            falls.append(fall(F.greatest(zero, *[p for p, _, _ in parts[:i]]), parts[i][1]))
        greatest, least = (lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]), (lambda xs: F.least(*xs) if len(xs) > 1 else xs[0])
        return {"_peak": greatest([p for p, _, _ in parts]), "_low": least([v for _, v, _ in parts]), "_fall": F.least(zero, *falls)}

    value = F.col(x)
    df = df.withColumns({"_peak": F.greatest(zero, value), "_low": value, "_fall": zero})
    size = 1
    while size < n:
        count = next((k for k in (5, 4, 3, 2) if n % (size * k) == 0), n // size)
        lag = lambda c, k: F.lag(c, k * size).over(by_date()) if k else F.col(c)
        df = df.withColumns(joined([(lag("_peak", k), lag("_low", k), lag("_fall", k)) for k in reversed(range(count))]))
        size *= count
    return df.withColumn(name, full(F.col("_fall") * 100, 2)).drop("_peak", "_low", "_fall")


def drawdown_ath(x: str = "close") -> Column:
    """Percent below the highest value so far."""
    return (F.try_divide(F.col(x), F.max(x).over(so_far())) - 1) * 100


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, ddof: int = 0, x: str = "close") -> DataFrame:
    """Bands of k deviations (population for ddof 0, sample for 1), %B, relative width, squeeze."""
    frame = trail(n)
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(x).over(frame)
    df = with_rn(df).withColumns({"bb_mid": sma(x, n), "_sd": full(sd, n)})
    df = df.withColumns({
        "bb_upper": F.col("bb_mid") + k * F.col("_sd"),
        "bb_lower": F.col("bb_mid") - k * F.col("_sd"),
    })
    spread = F.col("bb_upper") - F.col("bb_lower")
    df = df.withColumns({
        "bb_width": F.when(F.col("bb_mid") != 0, spread / F.col("bb_mid")),
        "bb_pct": F.when(F.col("bb_mid").isNotNull(),
                         F.when(spread != 0, (F.col(x) - F.col("bb_lower")) / spread * 100).otherwise(F.lit(50.0))),
        "bb_position": (F.col(x) - F.col("bb_lower")) / (spread + 1e-10),
    }).drop("_sd")
    # The squeeze compares with the least width of n rows, which needs n full widths; from
    # row n + 5 on it is defined, and false until that minimum exists.
    least = F.when(F.col("rn") >= 2 * n - 1, F.min("bb_width").over(trail(n)))
    squeeze = F.when(F.col("bb_width") <= least * 1.1, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.withColumn("bb_squeeze", full(squeeze, n + 5))


def stoch(df: DataFrame, k: int = 14, d: int = 3, flat: str = "half", x: str = "close",
          high: str = "high", low: str = "low") -> DataFrame:
    """%K and its mean %D. A flat range gives 50 ("half"), a tiny denominator ("epsilon") or NULL ("null")."""
    hi, lo = F.max(high).over(trail(k)), F.min(low).over(trail(k))
    if flat == "epsilon":
        raw = 100 * (F.col(x) - lo) / (hi - lo + 1e-10)
    else:
        empty = F.lit(50.0) if flat == "half" else F.lit(None).cast("double")
        raw = F.when(hi != lo, 100 * (F.col(x) - lo) / (hi - lo)).otherwise(empty)
    df = with_rn(df).withColumn("stoch_k", full(raw, k))
    frame = trail(d)
    mean = F.when(F.count("stoch_k").over(frame) == d, F.avg("stoch_k").over(frame))
    return df.withColumn("stoch_d", mean)


def williams_r(n: int = 14, x: str = "close", high: str = "high", low: str = "low") -> Column:
    hi, lo = F.max(high).over(trail(n)), F.min(low).over(trail(n))
    return full(-100 * (hi - F.col(x)) / (hi - lo + 1e-10), n)


def obv(df: DataFrame, x: str = "close", volume: str = "volume") -> DataFrame:
    """On-balance volume (starts at 0), its 20-row mean and the relative distance to it."""
    move = F.signum(F.col(x) - lagged(x)) * F.col(volume)
    df = with_rn(df).withColumn("_move", F.coalesce(move, F.lit(0.0)))
    df = df.withColumn("obv", F.sum("_move").over(so_far())).drop("_move")
    # The mean starts with the second row, where the first move exists.
    mean = F.when(F.col("rn") >= 21, F.avg("obv").over(trail(20)))
    df = df.withColumn("obv_ma20", mean)
    return df.withColumn("obv_vs_ma20", (F.col("obv") - F.col("obv_ma20")) / (F.abs("obv_ma20") + 1e-10))


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index; an unchanged typical price counts on neither side."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = with_rn(df).withColumn("tp", tp).withColumn("_tp1", lagged("tp"))
    flow = F.col("tp") * F.col("volume")
    up = F.sum(F.when(F.col("tp") > F.col("_tp1"), flow).otherwise(F.lit(0.0))).over(trail(n))
    down = F.sum(F.when(F.col("tp") < F.col("_tp1"), flow).otherwise(F.lit(0.0))).over(trail(n))
    return df.withColumn(f"mfi{n}", full(100 - 100 / (1 + up / (down + 1e-10)), n)).drop("_tp1")


def roc(n: int = 10, x: str = "close") -> Column:
    return F.try_divide(F.col(x), lagged(x, n)) - 1


def efficiency(df: DataFrame, n: int = 20, x: str = "close") -> DataFrame:
    """Net move over the path length of n moves; zero where nothing moved."""
    df = df if "diff" in df.columns else with_diff(df, x)
    path = F.sum(F.abs("diff")).over(trail(n))
    net = F.abs(F.col(x) - lagged(x, n))
    value = F.when(path > 0, net / path).otherwise(F.lit(0.0))
    return with_rn(df).withColumn(f"efficiency{n}", full(value, n + 1))


def streak(df: DataFrame, x: str = "close") -> DataFrame:
    """Length of the current run of rising (``up_streak``) or falling (``dn_streak``) days."""
    df = with_rn(df).withColumn("_sign", F.signum(F.col(x) - lagged(x)))
    turn = F.when(F.col("_sign") == lagged("_sign"), 0).otherwise(1)
    df = df.withColumn("_turn", turn)
    df = df.withColumn("_start", F.max(F.when(F.col("_turn") == 1, F.col("rn"))).over(so_far()))
    length = F.col("rn") - F.col("_start") + 1
    return df.withColumns({
        "up_streak": F.when(F.col("_sign") > 0, length).otherwise(0).cast("long"),
        "dn_streak": F.when(F.col("_sign") < 0, length).otherwise(0).cast("long"),
    }).drop("_sign", "_turn", "_start")


def range_pos(df: DataFrame, ns: Sequence[int] = (20, 60, 120, 252), x: str = "close") -> DataFrame:
    """Distance to the rolling high and low and the range, as fractions (more than n rows needed)."""
    df = with_extremes(with_rn(df), {
        **{f"_hi{n}": ("max", x, n) for n in ns}, **{f"_lo{n}": ("min", x, n) for n in ns}})
    out: dict[str, Column] = {}
    c, zero = F.col(x), F.lit(0.0)
    for n in ns:
        hi, lo = F.col(f"_hi{n}"), F.col(f"_lo{n}")
        out[f"close_vs_high_{n}d"] = full(F.when(hi > 0, (c - hi) / hi).otherwise(zero), n + 1)
        out[f"close_vs_low_{n}d"] = full(F.when(lo > 0, (c - lo) / lo).otherwise(zero), n + 1)
        out[f"range_pct_{n}d"] = full(F.when(lo > 0, (hi - lo) / lo).otherwise(zero), n + 1)
    return df.withColumns(out).drop(*[f"_hi{n}" for n in ns], *[f"_lo{n}" for n in ns])


def candle(df: DataFrame) -> DataFrame:
    """Gap, open-to-close and the anatomy of the day's candle. A missing open counts as the close."""
    has_open = F.coalesce(F.col("open") > 0, F.lit(False))
    prev = lagged("close")
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    o = F.when(has_open, F.col("open")).otherwise(c)
    rng = h - l
    some = rng > 0
    return df.withColumns({
        "gap_open": F.when(has_open & (prev > 0), F.col("open") / prev - 1),
        "open_to_close": F.when(has_open & (prev > 0), c / F.col("open") - 1),
        "daily_range": F.when(some & (c > 0), rng / c),
        "body_pct": F.when(some, F.abs(c - o) / rng),
        "upper_wick_pct": F.when(some, (h - F.greatest(c, o)) / rng),
        "lower_wick_pct": F.when(some, (F.least(c, o) - l) / rng),
        "close_location": F.when(some, (c - l) / rng).otherwise(0.5),
        "bullish_candle": F.when(c >= o, 1.0).otherwise(0.0),
    })


# ---- activity, flow, liquidity ---------------------------------------------------------------------

def same_shares(frame) -> Column:
    """Whether the listed shares of today are those of every row of the frame."""
    shares = num("shares")
    return (shares > 0) & (F.min(shares).over(frame) == shares) & (F.max(shares).over(frame) == shares)


def turnover_ratio(turnover: str, mean_turnover: str | Column, same: str | Column, mean_volume: str) -> Column:
    """Today's turnover against its mean. Unchanged shares cancel out: the ratio is that of the volumes, which are whole
    numbers, so a ratio that lies on a bound (1.2, 1.5) is not moved off it by dividing by the shares first."""
    return F.when(col(same), ratio(num("volume"), mean_volume)).otherwise(ratio(F.coalesce(F.col(turnover), F.lit(0.0)), mean_turnover))


def activity_ratios(df: DataFrame, n: int = 20) -> DataFrame:
    """Today against the mean of the n rows before it: volume, value, frequency and turnover.
    Turnover (volume over listed shares) is the preferred confirmation."""
    df = with_rn(df)
    frame = before(n)
    turnover = ratio(num("volume"), num("shares"))
    df = df.withColumns({
        f"avg_volume_{n}": full(F.avg(num("volume")).over(frame), n + 1),
        f"avg_value_{n}": full(F.avg(num("value")).over(frame), n + 1),
        f"avg_freq_{n}": full(F.avg(num("freq")).over(frame), n + 1),
        "_turnover": turnover, "_same_shares": same_shares(frame),
    })
    mean_turnover = F.when(F.count("_turnover").over(frame) == n, F.avg("_turnover").over(frame))
    df = df.withColumns({
        "volume_ratio": ratio(num("volume"), f"avg_volume_{n}"),
        "value_ratio": ratio(num("value"), f"avg_value_{n}"),
        "freq_ratio": ratio(num("freq"), f"avg_freq_{n}"),
        "turnover_ratio": turnover_ratio("_turnover", mean_turnover, "_same_shares", f"avg_volume_{n}"),
        "turnover_pct": F.col("_turnover") * 100,
    })
    return df.withColumn("confirmation_ratio", F.coalesce("turnover_ratio", "volume_ratio")).drop("_turnover", "_same_shares")


def relative_activity(ns: Sequence[int] = (5, 10, 20, 60)) -> dict[str, Column]:
    """Today against the mean of the last n rows including today."""
    out: dict[str, Column] = {}
    for n in ns:
        out |= _relative(n, F.avg("volume").over(trail(n)), F.avg("value").over(trail(n)))
    return out


def _relative(n: int, vol: Column, val: Column) -> dict[str, Column]:
    return {f"rel_volume_{n}d": full(F.col("volume") / (vol + 1e-10), n + 1), f"rel_value_{n}d": full(F.col("value") / (val + 1e-10), n + 1),
            f"avg_value_{n}d": full(val, n + 1)}


def with_relative_activity(df: DataFrame, ns: Sequence[int] = (5, 10, 20, 60)) -> DataFrame:
    """``relative_activity`` in two levels: the sum and the number of known values of several times ``SHORT`` rows are those of
    lagged frames of ``SHORT`` rows, so a row is read 20 times for the means of 20 and 60 rows instead of 80."""
    df, xs = with_rn(df), ("volume", "value")
    wide = [n for n in ns if n % SHORT == 0]
    if not wide:
        return df.withColumns(relative_activity(ns))
    kept = [f"_{kind}_{x}" for kind in ("sum", "n") for x in xs]
    df = df.withColumns({
        **{f"_sum_{x}": F.coalesce(F.sum(F.col(x).cast("double")).over(trail(SHORT)), F.lit(0.0)) for x in xs},
        **{f"_n_{x}": F.count(x).over(trail(SHORT)) for x in xs}, **relative_activity([n for n in ns if n not in wide])})

    def over(name: str, n: int) -> Column:
        total = F.col(name)
        for k in range(SHORT, n, SHORT):
            total = total + F.coalesce(lagged(name, k), F.lit(0))
        return total

    means = {f"_mean_{x}_{n}": F.try_divide(over(f"_sum_{x}", n), over(f"_n_{x}", n)) for n in wide for x in xs}
    df = df.withColumns(means)
    for n in wide:
        df = df.withColumns(_relative(n, F.col(f"_mean_volume_{n}"), F.col(f"_mean_value_{n}")))
    return df.drop(*kept, *means)


def breakout(df: DataFrame, n: int = 20) -> DataFrame:
    """Adjusted close beyond the highs or lows of the n rows before it."""
    df = df if "adj_high" in df.columns else back_adjust(df)
    hi, lo = F.max("adj_high").over(before(n)), F.min("adj_low").over(before(n))
    enough = F.col("rn") > n
    return df.withColumns({
        f"high_{n}": hi, f"low_{n}": lo,
        f"breakout_{n}": F.coalesce(enough & (F.col("adj") > hi), F.lit(False)),
        f"new_low_{n}": F.coalesce(enough & (F.col("adj") < lo), F.lit(False)),
    })


def levels(df: DataFrame, ns: Sequence[int] = (20, 55), year: int = 252, high: str = "adj_high",
           low: str = "adj_low", x: str = "adj") -> DataFrame:
    """Resistance and support of the last n rows, and the 52-week range (partial windows allowed)."""
    wanted: dict[str, tuple[str, str, int]] = {}
    for n in ns:
        wanted[f"resistance_{n}"] = ("max", high, n)
        wanted[f"support_{n}"] = ("min", low, n)
    wanted["high_52w"], wanted["low_52w"] = ("max", high, year), ("min", low, year)
    df = with_extremes(df, wanted)
    hi, lo = F.col("high_52w"), F.col("low_52w")
    return df.withColumns({
        "from_high_52w": F.when(hi > 0, (F.col(x) / hi - 1) * 100),
        "from_low_52w": F.when(lo > 0, (F.col(x) / lo - 1) * 100),
    })


def foreign_flow(df: DataFrame, ns: Sequence[int] = (5, 20)) -> DataFrame:
    """Net foreign shares, value estimate, share of days bought, day counts, percent of volume."""
    net = num("fbuy") - num("fsell")
    df = with_rn(df).withColumns({
        "net_1d": net,
        "_active": F.when(num("fbuy") + num("fsell") > 0, 1).otherwise(0),
    })
    out: dict[str, Column] = {}
    n1 = F.col("net_1d")
    for n in ns:
        frame = trail(n)
        active = F.sum("_active").over(frame)
        positive = F.sum(F.when(n1 > 0, 1).otherwise(0)).over(frame)
        negative = F.sum(F.when(n1 < 0, 1).otherwise(0)).over(frame)
        volume = F.sum(num("volume")).over(frame)
        out[f"net_{n}d"] = full(F.sum(n1).over(frame), n)
        out[f"net_value_{n}d"] = full(F.sum(n1 * num("close")).over(frame), n)
        out[f"consistency_{n}"] = full(F.when(active > 0, positive / active * 100), n)
        out[f"pos_days_{n}"] = full(positive, n)
        out[f"neg_days_{n}"] = full(negative, n)
        out[f"flat_days_{n}"] = full(F.lit(n) - positive - negative, n)
        out[f"net_volume_pct_{n}"] = full(F.when(volume != 0, F.sum(n1).over(frame) / volume * 100), n)
    return df.withColumns(out).drop("_active")


def foreign_ratio(ns: Sequence[int] = (1, 5, 10, 20)) -> dict[str, Column]:
    """Foreign shares over traded value (shares per unit of money); zero until there has been any
    foreign buying."""
    out: dict[str, Column] = {}
    ever = F.sum(num("fbuy")).over(so_far()) > 0
    for n in ns:
        frame = trail(n)
        base = F.sum(num("value")).over(frame) + 1
        on = ever & (F.col("rn") >= n)
        for name, x in (("net", num("fbuy") - num("fsell")), ("buy", num("fbuy")), ("sell", num("fsell"))):
            out[f"foreign_{name}_{n}d"] = F.when(on, F.sum(x).over(frame) / base).otherwise(F.lit(0.0))
    return out


def illiquidity(df: DataFrame, n: int = 20) -> DataFrame:
    """Price impact, two Amihud forms, share of inactive days and share of active days over n rows."""
    prev, close, value = num("prev"), num("close"), num("value")
    bn = value / 1e9
    df = with_rn(df)
    df = df if "pc" in df.columns else with_pct_change(df)
    df = df.withColumns({
        "_impact": F.when((prev > 0) & (bn > 0), F.abs(close / prev - 1) * 100 / bn),
        "_amihud": F.abs("pc") / (value + 1),
        "_amihud_bn": F.when(value > 0, F.abs("pc") / value * 1e9),
        "_idle": F.when(num("volume") > 0, 0.0).otherwise(1.0),
    })
    frame = trail(n)
    return df.withColumns({
        f"price_impact_{n}": full(F.avg("_impact").over(frame), n),
        f"amihud_{n}": full(F.avg("_amihud").over(frame), n),
        f"amihud_bn_{n}": full(F.avg("_amihud_bn").over(frame), n),
        f"zero_vol_{n}": full(F.avg("_idle").over(frame), n),
        f"active_pct_{n}": full((1 - F.avg("_idle").over(frame)) * 100, n),
    }).drop("_impact", "_amihud", "_amihud_bn", "_idle")


def liquidity_score(df: DataFrame, n: int = 20) -> DataFrame:
    """0-100 from the rolling medians of value and trade count; level by 80 and 50."""
    df = with_rn(df)
    frame = trail(n)
    df = df.withColumns({
        "med_value": full(F.percentile("value", 0.5).over(frame), n),
        "med_freq": full(F.percentile("freq", 0.5).over(frame), n),
    })
    points = 50 * F.least(F.col("med_value") / 1e10, F.lit(1.0)) + 50 * F.least(F.col("med_freq") / 1000, F.lit(1.0))
    score = full(points, n)  # least() skips NULLs, so the guard has to be repeated
    level = F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")
    return df.withColumns({"liq_score": score, "liq_level": F.when(score.isNotNull(), level)})


def flow_20d(n: int = 20) -> dict[str, Column]:
    """Net foreign over n rows and its percentage of twice the traded value (shares per money)."""
    frame = trail(n)
    net = full(F.sum(num("fbuy") - num("fsell")).over(frame), n)
    value = full(F.sum(num("value")).over(frame), n)
    return {f"flow_net_{n}": net, f"flow_pct_{n}": F.when(value > 0, net / (2 * value) * 100)}


def vol_price_corr(n: int = 5, x: str = "close") -> Column:
    """NULL where either side does not move (there the built-in correlation divides by zero)."""
    v, frame = F.col("volume").cast("double"), trail(n)
    spread = F.stddev_pop(v).over(frame) * F.stddev_pop(x).over(frame)
    return full(F.try_divide(F.covar_pop(v, F.col(x)).over(frame), spread), n)


def _split_like(share_ratio: Column, price_ratio: Column) -> Column:
    larger = F.greatest(share_ratio, price_ratio)
    agrees = F.abs(share_ratio - price_ratio) / larger <= 0.25
    fits = ((share_ratio > 1) & (price_ratio > 1.02)) | ((share_ratio < 1) & (price_ratio < 0.98))
    return (F.abs(share_ratio - 1) > 0.05) & agrees & fits


def with_splits(bars: DataFrame, name: str, shares: str = "shares") -> DataFrame:
    """Adds ``name``: 1 on the bars that ``corporate_actions`` calls split-like, else NULL. It comes from the windows per symbol, so bars
    that go on to others need not be worked out twice and joined to their actions."""
    traded = (num("close") > 0) & (num("volume") > 0) & (num(shares) > 0)
    earlier = by_date().rowsBetween(Window.unboundedPreceding, -1)
    last = lambda x: F.last(F.when(traded, F.col(x)), ignorenulls=True).over(earlier)
    df = bars.withColumns({"_shares_1": last(shares), "_close_1": last("close")})
    known = traded & F.col("_shares_1").isNotNull()
    df = df.withColumns({"_share_ratio": F.when(known, F.col(shares) / F.col("_shares_1")), "_price_ratio": F.when(known, F.col("_close_1") / F.col("close"))})
    flag = F.when(_split_like(F.col("_share_ratio"), F.col("_price_ratio")), 1)
    return df.withColumn(name, flag).drop("_shares_1", "_close_1", "_share_ratio", "_price_ratio")


def corporate_actions(bars: DataFrame) -> DataFrame:
    """Share-count changes above 1% between consecutive traded days. A split-like event also has
    a price move that fits the share ratio: within 25% of it and in the opposite direction."""
    traded = bars.filter((num("close") > 0) & (num("volume") > 0) & (num("shares") > 0))
    df = traded.withColumns({"shares_1": lagged("shares"), "close_1": lagged("close")})
    share_ratio = F.col("shares") / F.col("shares_1")
    price_ratio = F.col("close_1") / F.col("close")
    df = df.withColumns({"share_ratio": share_ratio, "price_ratio": price_ratio})
    df = df.filter((F.col("shares_1") > 0) & (F.abs(F.col("share_ratio") - 1) > 0.01))
    split = _split_like(F.col("share_ratio"), F.col("price_ratio"))
    return df.select(
        "sym", "d", "shares_1", "shares", "close_1", "close", "share_ratio", "price_ratio",
        F.when(split, "SPLIT_LIKE").otherwise("CAPITAL_CHANGE").alias("action"),
        F.when(split, "HIGH").otherwise("MEDIUM").alias("confidence"),
    )


def local_bottoms(n: int = 20, x: str = "close") -> Column:
    """The only minimum of the 2n+1 rows centred here (full window needed)."""
    frame = by_date().rowsBetween(-n, n)
    low = F.min(x).over(frame)
    ties = F.array_size(F.filter(F.collect_list(x).over(frame), lambda v: v == low))
    return (F.count(F.lit(1)).over(frame) == 2 * n + 1) & (F.col(x) == low) & (ties == 1)


def sparkline(n: int = 30, x: str = "close") -> Column:
    return F.collect_list(x).over(trail(n))


def downsample(df: DataFrame, n: int) -> DataFrame:
    """At most n evenly spaced rows per symbol, first and last included. A row stays when one of
    the n target positions rounds to it; no target list is joined."""
    df = with_rn(df).withColumn("_cnt", F.count(F.lit(1)).over(all_rows()))
    step = (F.col("_cnt") - 1) / F.lit(n - 1)
    i = F.col("rn") - 1
    nearest = F.ceil((i - 0.5) / step)  # least k with round(k * step) >= i, halves rounding up
    hit = F.floor(nearest * step + 0.5) == i
    return df.filter((F.col("_cnt") <= n) | (hit & (nearest < n))).drop("_cnt")
