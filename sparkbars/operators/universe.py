"""Point-in-time tradable universe for every date, training filters, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import num
from . import scale
from . import windows as w

# Default limits of the universe.
MIN_HISTORY = 120
MIN_VALUE = 2e8
MIN_FREQ = 30.0
MIN_PRICE = 50.0
MAX_ZERO_VOLUME = 0.20
MAX_DAYS_IDLE = 3
EVENT_DAYS = 120
EXTREME_MOVE = 0.20
EXTREME_DAYS = 4
WARNING_MOVE = 0.25

ELIGIBLE = ("ELIGIBLE", "CORPORATE_ACTION_WARNING")


def universe_series(bars: DataFrame, master: DataFrame | None = None, actions: DataFrame | str | None = None,
                    min_history: int = MIN_HISTORY, min_value: float = MIN_VALUE, min_freq: float = MIN_FREQ,
                    min_price: float = MIN_PRICE, extreme_days: int = EXTREME_DAYS, stat: str = "mean") -> DataFrame:
    """Status of every symbol on every date it has a bar, from rows up to that date only. One window
    chain replaces the loop over dates; look-backs in calendar days are differences of running totals.
    ``actions`` has (sym, d, confidence), or names a column of the bars that is 1 on the days of verified ones, which then
    need not be joined; ``stat`` chooses mean or median of the last 20 bars."""
    df = bars.filter(F.col("close").isNotNull())
    if isinstance(actions, str):
        df = df.withColumnRenamed(actions, "_ca")
    elif actions is not None:
        high = actions.filter(F.col("confidence") == "HIGH").select("sym", "d", F.lit(1).alias("_ca")).distinct()
        df = df.join(high, ["sym", "d"], "left")
    else:
        df = df.withColumn("_ca", F.lit(None).cast("int"))
    df = w.with_rn(df.withColumn("d", F.col("d").cast("date")))
    move = F.when(F.col("prev") > 0, F.abs((F.col("close") - F.col("prev")) / F.col("prev")))
    idle = F.when(num("volume") > 0, 0.0).otherwise(1.0)
    middle = (lambda x: F.percentile(x, 0.5)) if stat == "median" else F.avg
    # The last 20 priced rows, not the priced ones of the last 20 rows: a row counter of priced rows as range.
    some = F.col("close") > 0
    df = df.withColumns({"_move": move, "_idle": idle, "_nth": F.count(F.when(some, 1)).over(w.so_far())})
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    df = df.withColumns({"_warned": flag(F.col("_move") > WARNING_MOVE), "_jumped": flag(F.col("_move") >= EXTREME_MOVE)})
    df = df.withColumns({f"_{c}": F.when(some, F.col(c)) for c in ("close", "value", "freq")})
    last20 = Window.partitionBy("sym").orderBy("_nth").rangeBetween(-19, 0)
    df = df.withColumns({
        "history_days": F.col("rn"),
        "close_20": middle("_close").over(last20),
        "value_20": middle("_value").over(last20),
        "freq_20": middle("_freq").over(last20),
        "zero_vol_ratio": F.avg("_idle").over(w.so_far()),
        "last_active": F.max(F.when((num("volume") > 0) & (F.col("close") > 0), F.col("d"))).over(w.so_far()),
        "_warn": w.count_in_days("_warned", EVENT_DAYS), "_extreme": w.count_in_days("_jumped", EVENT_DAYS),
        "_verified": w.count_in_days("_ca", EVENT_DAYS),
    })
    if master is not None:
        df = df.join(master.select("sym", "board"), "sym", "left")
        watch = F.coalesce(F.col("board") == "Watchlist", F.lit(False))
    else:
        watch = F.lit(False)
    df = df.withColumns({
        "days_since_active": F.coalesce(F.datediff("d", "last_active"), F.lit(9999)),
        "on_watch_board": watch,
    })
    return classify(df, min_history, min_value, min_freq, min_price, extreme_days).select(*COLUMNS)


COLUMNS = ("sym", "d", "status", "history_days", "close_20", "value_20", "freq_20", "zero_vol_ratio", "last_active",
           "days_since_active", "has_action_warning", "has_verified_action", "pump_flag", "on_watch_board")


def classify(df: DataFrame, min_history: int, min_value: float, min_freq: float, min_price: float, extreme_days: int) -> DataFrame:
    """Flags and status, first match wins."""
    df = df.withColumns({
        "has_verified_action": F.coalesce(F.col("_verified"), F.lit(0)) > 0,
        "has_action_warning": (F.coalesce("_warn", F.lit(0)) > 0) | (F.coalesce("_verified", F.lit(0)) > 0),
        "pump_flag": F.col("on_watch_board") | (F.coalesce("_extreme", F.lit(0)) >= extreme_days),
    })
    c20 = F.coalesce("close_20", F.lit(0.0))
    status = (
        F.when(F.col("history_days") < min_history, "INSUFFICIENT_HISTORY")
        .when((c20 < min_price) & (c20 > 0), "PENNY_STOCK")
        .when(F.col("days_since_active") > MAX_DAYS_IDLE, "SUSPENDED")
        .when(F.col("zero_vol_ratio") > MAX_ZERO_VOLUME, "SUSPENDED")
        .when(F.col("pump_flag"), "GORENGAN_SUSPECTED")
        .when(F.coalesce("value_20", F.lit(0.0)) < min_value, "LOW_LIQUIDITY")
        .when(F.coalesce("freq_20", F.lit(0.0)) < min_freq, "LOW_LIQUIDITY")
        .when(F.col("has_action_warning"), "CORPORATE_ACTION_WARNING")
        .otherwise("ELIGIBLE"))
    return df.withColumn("status", status)


def universe(bars: DataFrame, asof: Column, master: DataFrame | None = None, actions: DataFrame | None = None,
             min_history: int = MIN_HISTORY, min_value: float = MIN_VALUE, min_freq: float = MIN_FREQ,
             min_price: float = MIN_PRICE, extreme_days: int = EXTREME_DAYS) -> DataFrame:
    """Every symbol's state as of one date, also for symbols without a bar on it: idle days and
    look-backs count to that date. One aggregation, and the last 20 bars by a per-task top 20."""
    past = bars.filter((F.col("d") <= asof) & F.col("close").isNotNull())
    since = F.date_sub(asof, EVENT_DAYS)
    move = F.when(F.col("prev") > 0, F.abs((F.col("close") - F.col("prev")) / F.col("prev")))
    recent = F.col("d") >= since
    per = past.groupBy("sym").agg(
        F.count(F.lit(1)).alias("history_days"), F.avg(F.when(num("volume") > 0, 0.0).otherwise(1.0)).alias("zero_vol_ratio"),
        F.max(F.when((num("volume") > 0) & (F.col("close") > 0), F.col("d"))).alias("last_active"),
        F.count_if(recent & (move > WARNING_MOVE)).alias("_warn"), F.count_if(recent & (move >= EXTREME_MOVE)).alias("_extreme"))
    last20 = scale.top_k(past.filter(F.col("close") > 0), ["sym"], [F.desc("d")], 20, rank="_k").groupBy("sym").agg(
        F.avg("close").alias("close_20"), F.avg("value").alias("value_20"), F.avg("freq").alias("freq_20"))
    df = per.join(last20, "sym", "left")
    if actions is not None:
        seen = actions.filter((F.col("confidence") == "HIGH") & F.col("d").between(since, asof))
        df = df.join(seen.groupBy("sym").agg(F.count(F.lit(1)).alias("_verified")), "sym", "left")
    else:
        df = df.withColumn("_verified", F.lit(0))
    if master is not None:
        df = df.join(master.select("sym", (F.col("board") == "Watchlist").alias("_w")), "sym", "left")
        df = df.withColumn("on_watch_board", F.coalesce("_w", F.lit(False)))
    else:
        df = df.withColumn("on_watch_board", F.lit(False))
    df = df.withColumns({"d": asof, "days_since_active": F.coalesce(F.datediff(asof, F.col("last_active")), F.lit(9999))})
    return classify(df, min_history, min_value, min_freq, min_price, extreme_days).select(*COLUMNS)


def eligible(states: DataFrame) -> DataFrame:
    return states.filter(F.col("status").isin(*ELIGIBLE))


def training_bars(bars: DataFrame, start: Column) -> DataFrame:
    """Bars that may teach a model: priced, traded, from the start date on."""
    return bars.filter((F.col("d") >= start) & (num("close") > 0) & (num("volume") > 0))


def quality_gate(bars: DataFrame, today: Column) -> DataFrame:
    """One row: share of missing opens and idle rows, age in days, and the verdict."""
    df = bars.agg(
        (F.count_if(num("open") <= 0) / F.count(F.lit(1))).alias("null_open"),
        (F.count_if(num("volume") <= 0) / F.count(F.lit(1))).alias("zero_volume"),
        F.datediff(today, F.max("d")).alias("age_days"))
    verdict = F.when((F.col("age_days") > 14) | (F.col("zero_volume") > 0.5), "fail").when(F.col("null_open") > 0.95, "warn").otherwise("ok")
    return df.withColumn("verdict", verdict)


def freshness(bars: DataFrame, today: Column, max_days: int = 5) -> DataFrame:
    df = bars.agg(F.max("d").alias("newest"))
    age = F.datediff(today, F.col("newest"))
    return df.withColumns({"age_days": age, "is_fresh": age <= max_days})
