"""The 129 model features of every (symbol, date).

All of them come from one pass over the sorted bars of many symbols at a time (``feature_arrays``). Where only some are
wanted, native windows on one exchange and sort give all but the recursive ones; those come from one grouped map at
the end, which keeps the partitioning. A feature of date d never reads a later row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import num
from . import feature_arrays as arrays
from . import windows as w
from .recurrences import with_recurrences

RETURN_LAGS = (1, 2, 3, 5, 10, 20, 60)
RANGE_WINDOWS = (20, 60, 120, 252)
SMA_WINDOWS = (5, 10, 20, 50, 100, 200)
EMA_WINDOWS = (5, 10, 20, 50, 100)
RSI_WINDOWS = (2, 5, 7, 14, 21)
ATR_WINDOWS = (5, 10, 14, 20)
VOL_WINDOWS = (5, 10, 20, 60)
FLOW_WINDOWS = (1, 5, 10, 20)
MIN_ROWS = 5


def feature_names() -> list[str]:
    """All 129 names, block by block."""
    names = [f"{p}_{n}d" for n in RETURN_LAGS for p in ("return", "log_return")]
    names += ["up_streak", "dn_streak"]
    names += [f"{p}_{n}d" for n in RANGE_WINDOWS for p in ("close_vs_high", "close_vs_low", "range_pct")]
    names += ["gap_open", "open_to_close", "daily_range", "body_pct", "upper_wick_pct", "lower_wick_pct", "close_location", "bullish_candle"]
    names += [f"{p}{n}" for n in SMA_WINDOWS for p in ("sma", "close_vs_sma")]
    names += [f"{p}{n}" for n in EMA_WINDOWS for p in ("ema", "close_vs_ema")]
    names += ["golden_cross", "sma50_vs_sma200", "ma_aligned_bull", "ma_aligned_bear", "sma20_slope", "efficiency_ratio_20d"]
    names += [f"rsi{n}" for n in RSI_WINDOWS] + ["stoch_k", "stoch_d", "macd_line", "macd_signal", "macd_hist", "macd_bullish", "williams_r", "roc10"]
    names += [x for n in ATR_WINDOWS for x in (f"atr{n}", f"atr{n}_pct")]
    names += [f"{p}{n}" for n in VOL_WINDOWS for p in ("hvol", "downside_vol")]
    names += ["bb_width", "bb_position", "bb_squeeze", "hvol_percentile_60d", "volume_today", "value_today", "freq_today"]
    names += [f"{p}_{n}d" for n in VOL_WINDOWS for p in ("rel_volume", "rel_value", "avg_value")]
    names += ["obv_vs_ma20", "vol_price_corr_5d", "zero_vol_pct_20d", "mfi14", "amihud_20d"]
    names += [f"foreign_{p}_{n}d" for n in FLOW_WINDOWS for p in ("net", "buy", "sell")]
    return names


# These need a day that traded.
VOLUME_BLOCK = (["volume_today", "value_today", "freq_today", "obv_vs_ma20", "vol_price_corr_5d", "zero_vol_pct_20d", "mfi14", "amihud_20d"]
                + [f"{p}_{n}d" for n in VOL_WINDOWS for p in ("rel_volume", "rel_value", "avg_value")])


def ma_structure(df: DataFrame) -> DataFrame:
    """Golden cross, alignment of averages, slope of the 20-row average; needs sma* and ema* columns."""
    s20, s50, s200, c = F.col("sma20"), F.col("sma50"), F.col("sma200"), F.col("close")
    e20, e50, e100 = F.col("ema20"), F.col("ema50"), F.col("ema100")
    known = e20.isNotNull() & e50.isNotNull() & e100.isNotNull()
    return df.withColumns({
        "golden_cross": F.when(s50.isNotNull() & (s200 > 0), (s50 > s200).cast("double")),
        "sma50_vs_sma200": F.when(s50.isNotNull() & (s200 > 0), s50 / s200 - 1),
        "ma_aligned_bull": F.when(known, ((c > e20) & (e20 > e50) & (e50 > e100)).cast("double")),
        "ma_aligned_bear": F.when(known, ((c < e20) & (e20 < e50) & (e50 < e100)).cast("double")),
    })


# What the columns that follow the recurrences read.
STRUCTURE = ("golden_cross", "sma50_vs_sma200", "ma_aligned_bull", "ma_aligned_bear")
RECURRENCES = [
    *[((f"ema{n}", f"close_vs_ema{n}", *(STRUCTURE if n in (20, 50, 100) else ())), (f"ema{n}", "ema", {"n": n})) for n in EMA_WINDOWS],
    *[((f"rsi{n}",), (f"rsi{n}", "rsi_ewm", {"n": n})) for n in RSI_WINDOWS],
    *[((f"atr{n}", f"atr{n}_pct"), (f"atr{n}", "atr_ewm", {"n": n})) for n in ATR_WINDOWS],
    (("macd_line", "macd_signal", "macd_hist", "macd_bullish"), ("_macd", "macd", {"seed": "first"})),
]


SHAPE = {"returns": RETURN_LAGS, "ranges": RANGE_WINDOWS, "sma": SMA_WINDOWS, "ema": EMA_WINDOWS, "rsi": RSI_WINDOWS, "atr": ATR_WINDOWS,
         "vols": VOL_WINDOWS, "flows": FLOW_WINDOWS}


def inputs(bars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return bars.select("sym", "d", *keep, F.col("open").cast("double").alias("open"), *[F.col(x).cast("double").alias(x) for x in ("high", "low", "close")],
                       *[num(x).alias(x) for x in ("volume", "value", "freq", "fbuy", "fsell")])


def all_features(bars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``features`` with nothing left out. The row number is the one window: it brings a symbol's bars together in date order, and
    tells the map that follows where a symbol begins."""
    df = inputs(bars, keep).withColumn("rn", F.row_number().over(w.by_date()))
    names, ids, kind = feature_names(), ["sym", "d", "close", "rn", *keep], dict(df.dtypes)
    schema = ", ".join([*[f"{n} {kind[n]}" for n in ids], *[f"{n} double" for n in names]])

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.whole_symbols(batches):
            yield from arrays.by_symbols(table, names, SHAPE, VOLUME_BLOCK, MIN_ROWS, ids)

    return df.mapInArrow(of_part, schema)


def features(bars: DataFrame, only: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """sym, d, close and the feature columns; the first four rows of a symbol carry none. ``only`` names the features wanted,
    else there are all 129: a map needs every column it is given, so Spark cannot leave out what nobody reads. Columns of
    the bars named by ``keep``, such as labels, are carried along.

    The windows for some of them are laid out in three levels, by what they read: previous rows of the
    input, then frames over those, then frames over frames. Each level is one pass over the sorted rows;
    the operators of ``windows`` say what each column means."""
    if only is None:
        return all_features(bars, keep)
    c, nul = F.col("close"), F.lit(None).cast("double")
    df = inputs(bars, keep).withColumn("tp", (F.col("high") + F.col("low") + c) / 3)

    # Level 1: lags.
    base = {n: w.lagged("close", n) for n in RETURN_LAGS}
    df = df.withColumns({"rn": F.row_number().over(w.by_date()), **{f"_c{n}": base[n] for n in RETURN_LAGS}, "_tp1": w.lagged("tp")})
    c1 = F.col("_c1")
    df = df.withColumns({
        "pc": F.try_divide(c, c1) - 1, "diff": c - c1, "_sign": F.signum(c - c1),
        **{f"return_{n}d": F.try_divide(c, F.col(f"_c{n}")) - 1 for n in RETURN_LAGS},
        **{f"log_return_{n}d": F.when(F.col(f"_c{n}") > 0, F.log(F.try_divide(c, F.col(f"_c{n}")))) for n in RETURN_LAGS},
        "_net20": F.abs(c - F.col("_c20")),
    })
    has_open = F.coalesce(F.col("open") > 0, F.lit(False))
    o, h, low = F.when(has_open, F.col("open")).otherwise(c), F.col("high"), F.col("low")
    rng, some = h - low, h - low > 0
    df = df.withColumns({
        "roc10": F.col("return_10d"),
        "gap_open": F.when(has_open & (c1 > 0), F.col("open") / c1 - 1), "open_to_close": F.when(has_open & (c1 > 0), c / F.col("open") - 1),
        "daily_range": F.when(some & (c > 0), rng / c), "body_pct": F.when(some, F.abs(c - o) / rng),
        "upper_wick_pct": F.when(some, (h - F.greatest(c, o)) / rng), "lower_wick_pct": F.when(some, (F.least(c, o) - low) / rng),
        "close_location": F.when(some, (c - low) / rng).otherwise(0.5), "bullish_candle": F.when(c >= o, 1.0).otherwise(0.0),
        "_move": F.coalesce(F.col("_sign") * F.col("volume"), F.lit(0.0)), "_down": F.when(F.col("pc") < 0, F.col("pc")).otherwise(0.0),
        "_am": F.abs("pc") / (F.col("value") + 1), "_idle": F.when(F.col("volume") == 0, 1.0).otherwise(0.0),
        "_up_flow": F.when(F.col("tp") > F.col("_tp1"), F.col("tp") * F.col("volume")).otherwise(0.0),
        "_dn_flow": F.when(F.col("tp") < F.col("_tp1"), F.col("tp") * F.col("volume")).otherwise(0.0),
    }).drop("_tp1", *[f"_c{n}" for n in RETURN_LAGS])

    # Level 2: frames over inputs and level 1.
    t = w.trail
    df = df.withColumns({
        **{f"hvol{n}": w.hvol(n) for n in VOL_WINDOWS},
        **{f"downside_vol{n}": w.full(F.stddev_samp("_down").over(t(n)) * w.YEAR, n + 1) for n in VOL_WINDOWS},
        **w.relative_activity(VOL_WINDOWS), **w.foreign_ratio(FLOW_WINDOWS), "vol_price_corr_5d": w.vol_price_corr(5),
        "_hi14": F.max("high").over(t(14)), "_lo14": F.min("low").over(t(14)), "_path": F.sum(F.abs("diff")).over(t(20)),
        "_hi20": F.max("close").over(t(20)), "_lo20": F.min("close").over(t(20)),
        **{f"sma{n}": w.sma("close", n) for n in (5, 10, 20)}, "_sum10": F.sum("close").over(t(10)), "_sd20": w.full(F.stddev_samp("close").over(t(20)), 20),
        "_obv": F.sum("_move").over(w.so_far()), "_mfi_up": F.sum("_up_flow").over(t(14)), "_mfi_dn": F.sum("_dn_flow").over(t(14)),
        "amihud_20d": w.full(F.avg("_am").over(t(20)), 20), "zero_vol_pct_20d": w.full(F.avg("_idle").over(t(20)), 20),
        "_turn": F.when(F.col("_sign") == w.lagged("_sign"), nul).otherwise(F.col("rn")),
    })
    hi, lo, s20 = F.col("_hi14"), F.col("_lo14"), F.col("sma20")
    upper, lower = s20 + 2 * F.col("_sd20"), s20 - 2 * F.col("_sd20")
    df = df.withColumns({
        "stoch_k": w.full(100 * (c - lo) / (hi - lo + 1e-10), 14), "williams_r": w.full(-100 * (hi - c) / (hi - lo + 1e-10), 14),
        "efficiency_ratio_20d": w.full(F.when(F.col("_path") > 0, F.col("_net20") / F.col("_path")).otherwise(0.0), 21),
        "bb_width": F.when(s20 != 0, (upper - lower) / s20), "bb_position": (c - lower) / (upper - lower + 1e-10),
        "mfi14": w.full(100 - 100 / (1 + F.col("_mfi_up") / (F.col("_mfi_dn") + 1e-10)), 14),
    }).drop("_hi14", "_lo14", "_path", "_net20", "_sd20", "_mfi_up", "_mfi_dn", "_move", "_down", "_am", "_idle", "_up_flow", "_dn_flow", "diff", "tp")

    # Level 3: frames over level 2; wide sums and extremes from lagged short ones.
    back = lambda x, k: F.lag(x, k).over(w.by_date())
    wide: dict[str, Column] = {}
    for n in (50, 100, 200):
        total = F.col("_sum10")
        for k in range(10, n, 10):
            total = total + back("_sum10", k)
        wide[f"sma{n}"] = w.full(total / n, n)
    for n in RANGE_WINDOWS[1:]:
        steps = [*range(w.SHORT, n - w.SHORT, w.SHORT), n - w.SHORT]
        wide[f"_hi{n}"] = F.greatest("_hi20", *[back("_hi20", k) for k in steps])
        wide[f"_lo{n}"] = F.least("_lo20", *[back("_lo20", k) for k in steps])
    slope = w.lagged("sma20", 5)
    df = df.withColumns({
        **wide, "_k_n": F.count("stoch_k").over(t(3)), "_k_mean": F.avg("stoch_k").over(t(3)), "_bb_least": F.min("bb_width").over(t(20)),
        "_seen": F.collect_list("hvol20").over(t(60)), "_obv20": F.avg("_obv").over(t(20)), "_start": F.max("_turn").over(w.so_far()),
        "sma20_slope": F.when(slope > 0, s20 / slope - 1),
    })
    run, now, mean = F.col("rn") - F.col("_start") + 1, F.col("hvol20"), F.col("_obv20")
    squeeze = F.when((F.col("rn") >= 39) & (F.col("bb_width") <= F.col("_bb_least") * 1.1), 1.0).otherwise(0.0)
    zero = F.lit(0.0)
    ranges: dict[str, Column] = {}
    for n in RANGE_WINDOWS:
        top, bottom = F.col(f"_hi{n}"), F.col(f"_lo{n}")
        ranges[f"close_vs_high_{n}d"] = w.full(F.when(top > 0, (c - top) / top).otherwise(zero), n + 1)
        ranges[f"close_vs_low_{n}d"] = w.full(F.when(bottom > 0, (c - bottom) / bottom).otherwise(zero), n + 1)
        ranges[f"range_pct_{n}d"] = w.full(F.when(bottom > 0, (top - bottom) / bottom).otherwise(zero), n + 1)
    df = df.withColumns({
        **ranges, "stoch_d": F.when(F.col("_k_n") == 3, F.col("_k_mean")), "bb_squeeze": w.full(squeeze, 25),
        "hvol_percentile_60d": F.when((F.col("rn") >= 60) & (F.size("_seen") >= 10) & now.isNotNull(),
                                      F.size(F.filter("_seen", lambda v: v <= now)) / F.size("_seen")),
        "obv_vs_ma20": F.when(F.col("rn") >= 21, (F.col("_obv") - mean) / (F.abs(mean) + 1e-10)),
        "up_streak": F.when(F.col("_sign") > 0, run).otherwise(0), "dn_streak": F.when(F.col("_sign") < 0, run).otherwise(0),
        **{f"close_vs_sma{n}": F.when(F.col(f"sma{n}") > 0, c / F.col(f"sma{n}") - 1) for n in SMA_WINDOWS},
        "volume_today": F.col("volume"), "value_today": F.col("value"), "freq_today": F.col("freq"),
    })
    unknown = sorted(set(only) - set(feature_names()))
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    wanted = [n for n in feature_names() if n in set(only)]
    read = {*wanted, "volume_today", *(("sma20", "sma50", "sma200") if set(wanted) & set(STRUCTURE) else ())}
    df = df.select("sym", "d", *keep, "rn", "close", "high", "low", *[n for n in feature_names() if n in df.columns and n in read])
    needed = [spec for names, spec in RECURRENCES if set(names) & set(wanted)]
    df = with_recurrences(df, needed) if needed else df
    df = ma_structure(df) if set(wanted) & set(STRUCTURE) else df
    long_enough = F.col("rn") >= 26
    late = {
        **{f"close_vs_ema{n}": F.when(F.col(f"ema{n}") > 0, c / F.col(f"ema{n}") - 1) for n in EMA_WINDOWS},
        **{f"atr{n}_pct": F.when(c > 0, F.col(f"atr{n}") / c) for n in ATR_WINDOWS},
        **{f"macd_{p}": F.when(long_enough & (c != 0), F.col(f"_macd_{p}") / c) for p in ("line", "signal", "hist")},
        "macd_bullish": F.when(long_enough, F.when(F.col("_macd_hist") > 0, 1.0).otherwise(0.0)),
    }
    df = df.withColumns({n: x for n, x in late.items() if n in wanted})
    traded = (F.col("rn") >= 2) & (F.coalesce("volume_today", F.lit(0.0)) > 0)
    out = [(F.when(traded, F.col(n)) if n in VOLUME_BLOCK else F.col(n)).cast("double").alias(n) for n in wanted]
    return df.filter(F.col("rn") >= MIN_ROWS).select("sym", "d", "close", "rn", *keep, *out)


# Columns that identify a row or hold an outcome; never inputs of a model.
NOT_FEATURES = ("sym", "d", "rn", "close", "status", "sector", "market_regime", "entry_price", "exit_price", "exit_date", "trade_return", "label",
                "has_labels", "is_inference", "tp_sl_success", "days_to_tp", "mfe", "mae", "current_close", "fold", "s",
                "future_return_1d", "future_return_3d", "future_return_5d", "future_return_10d")


def feature_cols(df: DataFrame) -> list[str]:
    """Numeric columns that may enter a model."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES]
