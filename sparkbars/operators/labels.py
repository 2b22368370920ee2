"""Forward labels on the market calendar, leakage checks, dataset assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import market_calendar
from ..sources.store import write_bucketed
from . import windows as w
from .features import NOT_FEATURES

FORWARD = (1, 3, 5, 10)


def labels(bars: DataFrame, h: int = 5, target: float = 0.02, take_profit: float = 0.03, stop_loss: float = -0.02,
           ambiguous: str = "loss") -> DataFrame:
    """Labels of every priced bar. The k-th future session is the market's, not the symbol's: a row
    looks at session index s + k and finds NULL where the symbol has no bar. Rows without h future
    market sessions stay as inference rows; rows whose exit bar is missing are dropped."""
    calendar = bars if "s" in bars.columns else None
    df = bars if calendar is not None else bars.join(market_calendar(bars), "d")
    last = df.agg(F.max("s")).scalar()
    df = df.filter(F.col("close").isNotNull())

    def at(k: int, x: str) -> Column:
        """Column x on session s + k: a range frame of width one holds that bar or nothing."""
        return F.max(x).over(Window.partitionBy("sym").orderBy("s").rangeBetween(k, k))

    ks = sorted({*FORWARD, h})
    df = df.withColumns({**{f"_c{k}": at(k, "close") for k in ks}, "_o1": at(1, "open"),
                         **{f"_h{k}": at(k, "high") for k in range(1, h + 1)}, **{f"_l{k}": at(k, "low") for k in range(1, h + 1)}})
    positive = lambda x: F.when(x > 0, x)
    close = F.col("close")
    entry = F.coalesce(positive(F.col("_o1")), close)
    ready = F.col("s") + h <= last
    df = df.filter(close > 0).withColumns({"has_labels": ready, "_entry": entry, "_exit": positive(F.col(f"_c{h}"))})
    df = df.filter(~ready | F.col("_exit").isNotNull())
    ret = F.col("_exit") / F.col("_entry") - 1
    tp, sl = F.col("_entry") * (1 + take_profit), F.col("_entry") * (1 + stop_loss)
    tp_day = F.coalesce(*[F.when(F.col(f"_h{k}") >= tp, k) for k in range(1, h + 1)])
    sl_day = F.coalesce(*[F.when(F.col(f"_l{k}") <= sl, k) for k in range(1, h + 1)])
    up = [F.when(F.col(f"_h{k}") > 0, F.col(f"_h{k}") / F.col("_entry") - 1) for k in range(1, h + 1)]
    down = [F.when(F.col(f"_l{k}") > 0, F.col(f"_l{k}") / F.col("_entry") - 1) for k in range(1, h + 1)]
    df = df.withColumns({"trade_return": ret, "_tp": tp_day, "_sl": sl_day})
    t, s = F.col("_tp"), F.col("_sl")
    same = F.lit(None).cast("int") if ambiguous != "loss" else F.lit(0)
    outcome = (
        F.when(t.isNotNull() & s.isNull(), 1).when(s.isNotNull() & t.isNull(), 0)
        .when(t < s, 1).when(s < t, 0).when(t == s, same)
        .otherwise((F.col("trade_return") >= 0).cast("int")))
    won = t.isNotNull() & (s.isNull() | (t < s))
    only = lambda x: F.when(F.col("has_labels"), x)
    return df.select(
        "sym", "d", "s", close.alias("current_close"), "has_labels", (~F.col("has_labels")).alias("is_inference"),
        only(F.col("_entry")).alias("entry_price"), only(F.col("_exit")).alias("exit_price"), only(F.col("trade_return")).alias("trade_return"),
        only((F.col("trade_return") >= target).cast("int")).alias("label"),
        *[only(F.when(F.col(f"_c{k}") > 0, F.col(f"_c{k}") / close - 1)).alias(f"future_return_{k}d") for k in FORWARD],
        only(F.greatest(F.lit(0.0), *up)).alias("mfe"), only(F.least(F.lit(0.0), *down)).alias("mae"),
        only(outcome).alias("tp_sl_success"), only(F.when(won, t)).alias("days_to_tp"))


def labels_fast(bars: DataFrame, h: int = 5, target: float = 0.02, take_profit: float = 0.05, stop_loss: float = -0.02,
                legacy_window: bool = False) -> DataFrame:
    """Training label on the symbol's own bars: entry at the close, exit h bars later, target and stop
    by the extremes of the bars after the entry. ``legacy_window`` looks h - 1 bars further instead. ``exit_date`` is
    the last date that the label looks at: a training row must have it before the validation starts."""
    df = with_labels_fast(bars, h, target, take_profit, stop_loss, legacy_window).filter(F.col("exit_price").isNotNull())
    return df.select("sym", "d", F.col("close").alias("entry_price"), *OUTCOME)


#: What ``with_labels_fast`` adds.
OUTCOME = ("exit_price", "exit_date", "trade_return", "label")


def with_labels_fast(bars: DataFrame, h: int = 5, target: float = 0.02, take_profit: float = 0.05, stop_loss: float = -0.02,
                     legacy_window: bool = False) -> DataFrame:
    """``labels_fast`` beside the bars, all of which stay: without an exit price there is no label. Bars that go on to ``features``
    carry them along in the same exchange, so the two need not be joined."""
    lo, hi = (h - 1, 2 * h - 2) if legacy_window else (1, h)
    frame = w.by_date().rowsBetween(lo, hi)
    df = bars.withColumns({
        "exit_price": F.lead("close", h).over(w.by_date()), "exit_date": F.lead("d", hi).over(w.by_date()), "_hi": F.max("high").over(frame), "_lo": F.min("low").over(frame)})
    entry = F.when(F.col("close") != 0, F.col("close"))
    df = df.withColumn("trade_return", (F.col("exit_price") - F.col("close")) / entry)
    tp = F.coalesce((F.col("_hi") - F.col("close")) / entry >= take_profit, F.lit(False))
    sl = F.coalesce((F.col("_lo") - F.col("close")) / entry <= stop_loss, F.lit(False))
    label = (F.when(F.col("exit_price").isNull(), None).when(tp & sl, (F.col("trade_return") > 0).cast("int")).when(tp, 1).when(sl, 0)
             .otherwise((F.col("trade_return") >= target).cast("int")))
    return df.withColumn("label", label).drop("_hi", "_lo")


LABEL_COLUMNS = ("weekly_bullish", "label", "tp_sl_success", "trade_return", "future_return_5d")


def leakage(features: DataFrame, feature_columns: list[str], feature_date: str = "feature_as_of", signal_date: str = "d") -> list[str]:
    """Violations as text: features dated after the signal, outcome columns among the inputs."""
    found = []
    if feature_date in features.columns:
        bad = features.filter(F.col(feature_date) > F.col(signal_date)).count()
        if bad:
            found.append(f"{bad} rows have features dated after the signal")
    leaked = sorted(set(feature_columns) & (set(LABEL_COLUMNS) | set(NOT_FEATURES)))
    if leaked:
        found.append(f"outcome columns among features: {leaked}")
    return found


def purge_is_safe(purge_days: int, h: int) -> bool:
    """The gap between training and validation must exceed the label horizon."""
    return purge_days > h


def dataset(features: DataFrame, labelled: DataFrame, universe: DataFrame | None = None, market: DataFrame | None = None,
            ranks: DataFrame | None = None, sector: DataFrame | None = None, every: int = 1, cap: int | None = None) -> DataFrame:
    """Features with labels by (symbol, date), only eligible rows of each date, every k-th session,
    with market, rank and sector features where given. ``cap`` bounds the rows of a sample on request: those first by a
    hash of (symbol, date), the same on every run."""
    df = features.join(labelled.drop("current_close"), ["sym", "d"])
    if universe is not None:
        df = df.join(universe.filter(F.col("status").isin("ELIGIBLE", "CORPORATE_ACTION_WARNING")).select("sym", "d"), ["sym", "d"], "left_semi")
    if every > 1:
        kept = market_calendar(features).filter((F.col("s") - 1) % every == 0).select("d")
        df = df.join(kept, "d", "left_semi")
    if market is not None:
        df = df.join(market, "d", "left")
    for extra in (ranks, sector):
        if extra is not None:
            df = df.join(extra, ["sym", "d"], "left")
    return df.orderBy(F.xxhash64("sym", "d"), "sym", "d").limit(cap) if cap else df


#: The parts of a training store, each keyed by (symbol, date).
STORED = ("features", "labels", "universe", "ranks")


def store_training(name: str, buckets: int, features: DataFrame, labelled: DataFrame, universe: DataFrame | None = None,
                   ranks: DataFrame | None = None, path: str | None = None) -> None:
    """Writes what a data set is assembled from as tables ``<name>_features`` and so on, bucketed alike by (symbol, date):
    computed once, they are joined as often as wanted without an exchange. ``buckets`` is best a multiple of the
    executors' cores that leaves some hundred megabytes a file."""
    for part, df in zip(STORED, (features, labelled, universe, ranks)):
        if df is not None:
            write_bucketed(df, f"{name}_{part}", buckets, ("sym", "d"), f"{path}/{part}" if path else None)


def stored_dataset(spark: SparkSession, name: str, market: DataFrame | None = None, every: int = 1, cap: int | None = None) -> DataFrame:
    """``dataset`` of the tables that ``store_training`` wrote; parts that were not stored are left out."""
    parts = {part: spark.table(f"{name}_{part}") if spark.catalog.tableExists(f"{name}_{part}") else None for part in STORED}
    return dataset(parts["features"], parts["labels"], parts["universe"], market, parts["ranks"], every=every, cap=cap)
