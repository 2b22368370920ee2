"""Model jobs on the feature table: folds, Spark ML pipelines, calibration, metrics, thresholds,
ensembles, index direction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scale
from . import windows as w

# Fees and slippage of one round trip.
BUY_FEE, SELL_FEE, SLIPPAGE = 0.00155, 0.00255, 0.001
ROUND_TRIP = BUY_FEE + SELL_FEE + 2 * SLIPPAGE
Z95 = 1.96


def rate(hits: Column, n: Column, prefix: str) -> dict[str, Column]:
    """A proportion with its 95% score interval as columns ``<prefix>``, ``<prefix>_lo``, ``<prefix>_hi``.

    The bounds are the two proportions q with (hits / n - q)^2 = z^2 q (1 - q) / n, the roots of
    (n + z^2) q^2 - (2 hits + z^2) q + hits^2 / n = 0. Without observations: 0 within (0, 1)."""
    z2 = Z95 ** 2
    some = n > 0
    a, b = n + z2, 2 * hits + z2
    root = F.sqrt(F.greatest(b * b - 4 * a * hits * hits / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return {
        prefix: F.when(some, hits / n).otherwise(F.lit(0.0)),
        # The proportion lies between its bounds; rounding must not let them cross it.
        f"{prefix}_lo": F.when(some, F.greatest(F.least((b - root) / (2 * a), hits / n), F.lit(0.0))).otherwise(F.lit(0.0)),
        f"{prefix}_hi": F.when(some, F.least(F.greatest((b + root) / (2 * a), hits / n), F.lit(1.0))).otherwise(F.lit(1.0)),
    }


# ---- folds and pipelines -----------------------------------------------------------------------

def folds(spark: SparkSession, start: str | Column, end: str | Column, train_months: int = 24, val_months: int = 3, purge_days: int = 5,
          slide_months: int = 3) -> DataFrame:
    """Walk-forward boundaries: train [start, start + months], a purge, then validation; the validation end is cut to
    the period's end. There are as many folds as the period has room for."""
    first, limit = F.lit(start).cast("date"), F.lit(end).cast("date")
    last = F.greatest(F.lit(0), F.ceil(F.months_between(limit, first) / slide_months))
    df = spark.range(1).select(first.alias("_start"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("fold"))
    df = df.withColumn("train_start", F.add_months("_start", F.col("fold") * slide_months)).drop("_start")
    df = df.withColumn("train_end", F.add_months("train_start", train_months))
    df = df.withColumn("val_start", F.date_add("train_end", purge_days))
    df = df.filter(F.col("val_start") <= limit)
    return df.withColumn("val_end", F.least(F.add_months("val_start", val_months), limit))


def in_folds(rows: DataFrame, fold_table: DataFrame, embargo_days: int = 0) -> DataFrame:
    """Every row of ``(d, exit_date, ...)`` once per fold it takes part in, with its ``part``: train, purged or val.

    A training row whose label looks into the validation period, or up to ``embargo_days`` before it, is purged: the
    exit date decides, not a fixed number of days. Rows meet folds by an equi-join: a row names the few folds
    whose span can hold its date, from the table's own regular grid."""
    grid = fold_table.agg(F.min("train_start").alias("a"), F.max("train_start").alias("b"), F.max("fold").alias("n"),
                          F.max(F.datediff("val_end", "train_start")).alias("span"))
    first, last, n, span = (grid.select(c).scalar() for c in ("a", "b", "n", "span"))
    stride = F.greatest(F.datediff(last, first) / F.greatest(n, F.lit(1)), F.lit(1.0))
    since = F.datediff("d", first)
    low = F.greatest(F.lit(0), F.floor((since - span) / stride) - 1).cast("int")
    high = F.least(n, F.ceil(since / stride) + 1).cast("int")
    near = rows.filter(since >= 0).filter(low <= high).withColumn("fold", F.explode(F.sequence(low, high))).join(fold_table, "fold")
    train = F.col("d").between(F.col("train_start"), F.col("train_end"))
    late = F.coalesce(F.col("exit_date") >= F.date_sub("val_start", embargo_days), F.lit(False))
    part = F.when(train & late, "purged").when(train, "train").when(F.col("d").between(F.col("val_start"), F.col("val_end")), "val")
    return near.withColumn("part", part).filter("part is not null")


def fold_rows(rows: DataFrame, fold_table: DataFrame, embargo_days: int = 0) -> DataFrame:
    """Per fold: rows trained on, purged and validated on, and the last date a training label looks at. Rows are counted
    per (date, exit date) before they meet the folds."""
    counted = rows.groupBy("d", "exit_date").agg(F.count(F.lit(1)).alias("n"))
    of = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0))
    return in_folds(counted, fold_table, embargo_days).groupBy("fold", "train_start", "train_end", "val_start", "val_end").agg(
        of("train").alias("n_train"), of("purged").alias("n_purged"), of("val").alias("n_val"),
        F.max(F.when(F.col("part") == "train", F.col("exit_date"))).alias("last_exit"))


MODELS = ("logistic", "random_forest", "gradient_boosting")


def make_pipeline(name: str, columns: Sequence[str], label: str = "label", seed: int = 42) -> Pipeline:
    """Median imputation and, for the linear model, scaling; classes balanced by weight."""
    filled = [f"_{c}" for c in columns]
    stages = [Imputer(strategy="median", inputCols=list(columns), outputCols=filled),
              VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="keep")]
    inputs = "_raw"
    if name == "logistic":
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True))
        inputs = "_scaled"
    common = {"featuresCol": inputs, "labelCol": label, "weightCol": "_weight"}
    model = {
        "logistic": lambda: LogisticRegression(maxIter=100, regParam=0.01, **common),
        "random_forest": lambda: RandomForestClassifier(numTrees=60, maxDepth=8, seed=seed, **common),
        "gradient_boosting": lambda: GBTClassifier(maxIter=40, maxDepth=4, seed=seed, **common),
    }[name]()
    return Pipeline(stages=[*stages, model])


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights that make both classes count alike: n / (2 n_class)."""
    rate = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    weight = F.when(F.col(label) == 1, F.lit(0.5) / rate).otherwise(F.lit(0.5) / (1 - rate))
    return df.withColumn("_weight", weight)


def score(model, df: DataFrame, name: str = "p") -> DataFrame:
    """Positive-class probability as a plain column."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def walk_forward(df: DataFrame, fold_table: DataFrame, columns: Sequence[str], model: str = "logistic", label: str = "label",
                 min_rows: int = 100, min_val: int = 20, min_class: int = 10, embargo_days: int = 0,
                 fallback: tuple[str, str, str, str] | None = None, keep: Sequence[str] = ("sym", "d", "trade_return")) -> DataFrame:
    """Out-of-sample scores of every fold. The fold table (a few boundary rows) is read by the driver, which starts one
    distributed fit per fold; the data stay on the executors.

    Training rows must have left their trade (``exit_date``) before the validation starts, less the embargo. Folds
    with too few training or validation rows or too few of a class are skipped. Without any fold, ``fallback`` (train
    start, train end, validation start, validation end) is the only one."""
    df = df.filter(F.col(label).isin(0, 1)).persist()
    bounds = [(f.fold, f.train_start, f.train_end, f.val_start, f.val_end) for f in fold_table.orderBy("fold").toLocalIterator()]
    if not bounds and fallback:
        bounds = [(0, *[F.lit(x).cast("date") for x in fallback])]
    out = None
    for fold, train_start, train_end, val_start, val_end in bounds:
        train = df.filter(F.col("d").between(train_start, train_end) & (F.col("exit_date") < F.date_sub(F.lit(val_start), embargo_days)))
        val = df.filter(F.col("d").between(val_start, val_end))
        sizes = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("ones")).first()
        if sizes.n < min_rows or min(sizes.ones, sizes.n - sizes.ones) < min_class or val.limit(min_val).count() < min_val:
            continue
        fitted = make_pipeline(model, columns, label).fit(with_class_weights(train, label))
        part = score(fitted, val).select(*keep, label, "p").withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    if out is None:
        df.unpersist()
        raise ValueError("no fold has enough rows")
    out = out.persist()
    out.count()  # the scores are kept, the features may go
    df.unpersist()
    return out


def calibrate(scored: DataFrame, label: str = "label", p: str = "p", step: float = 1e-4):
    """Isotonic calibration, to be fitted on a slice that neither trains nor evaluates the model. Scores are pooled
    into steps of ``step`` first, with their number as weight, so what the fit gathers is bounded."""
    pooled = scored.groupBy((F.round(F.col(p) / step) * step).alias(p)).agg(
        F.avg(F.col(label).cast("double")).alias(label), F.count(F.lit(1)).cast("double").alias("_n"))
    return IsotonicRegression(featuresCol=p, labelCol=label, weightCol="_n", predictionCol="p_calibrated").fit(pooled)


# ---- metrics ------------------------------------------------------------------------------------

def metrics(scored: DataFrame, threshold: float, by: Sequence[str] = (), label: str = "label", p: str = "p") -> DataFrame:
    """Counts, precision with interval, coverage, recall, Brier score, ROC and PR areas per group.

    The areas come from running totals per distinct probability, which ``scale`` computes without
    sorting a group in one task."""
    hit = F.col(p) >= threshold
    y = F.col(label) == 1
    n = F.count(F.lit(1))
    base = scored.groupBy(*by).agg(
        n.alias("candidates"), F.count_if(hit).alias("signals"), F.count_if(hit & y).alias("correct"), F.count_if(y).alias("positives"),
        F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))
    base = base.withColumns({
        "false_positives": F.col("signals") - F.col("correct"), **rate(F.col("correct"), F.col("signals"), "precision"),
        "coverage": F.col("signals") / F.col("candidates"),
        "recall": F.when(F.col("positives") > 0, F.col("correct") / F.col("positives")).otherwise(F.lit(0.0))})
    one = [*by] if by else ["_all"]
    rows = scored if by else scored.withColumn("_all", F.lit(1))
    cum = scale.cumulate(rows, one, p, {"pos": F.sum(F.col(label).cast("long")), "tot": F.count(F.lit(1))}, descending=True)
    neg, neg_before = F.col("tot") - F.col("pos"), F.col("tot_before") - F.col("pos_before")
    neg_all = F.col("tot_all") - F.col("pos_all")
    beaten = F.col("pos") * (neg_all - neg_before - neg + neg / 2)
    at = F.col("pos") * (F.col("pos_before") + F.col("pos")) / (F.col("tot_before") + F.col("tot"))
    areas = cum.groupBy(*one).agg(
        (F.sum(beaten) / F.max(F.nullif(F.col("pos_all") * neg_all, F.lit(0)))).alias("roc_auc"),
        (F.sum(at) / F.max(F.nullif(F.col("pos_all"), F.lit(0)))).alias("pr_auc"))
    if by:
        return base.join(areas, one)
    return base.withColumn("_all", F.lit(1)).join(areas, "_all").drop("_all")


def trade_metrics(scored: DataFrame, threshold: float, by: Sequence[str] = (), p: str = "p", ret: str = "trade_return",
                  cost: float = ROUND_TRIP) -> DataFrame:
    """Gross and net means, win rate, mean win and loss, profit factor, expectancy of the signals."""
    net = F.col(ret) - cost
    win = net > 0
    agg = scored.filter((F.col(p) >= threshold) & F.col(ret).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(ret).alias("gross_return"), F.avg(net).alias("net_return"), F.avg(win.cast("int")).alias("win_rate"),
        F.coalesce(F.avg(F.when(win, net)), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(F.when(~win, net)), F.lit(0.0)).alias("mean_loss"),
        F.try_divide(F.coalesce(F.sum(F.when(win, net)), F.lit(0.0)), F.abs(F.sum(F.when(~win, net)))).alias("profit_factor"))
    return agg.withColumn("expectancy", F.col("net_return"))


def threshold_table(scored: DataFrame, by: Sequence[str] = (), label: str = "label", p: str = "p") -> DataFrame:
    """Signals and hits at each threshold .50, .51 .. .98, from a histogram of at most 101 bins per
    group and a running sum from the top."""
    rows = scored.filter(F.col(p).isNotNull())
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"))
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(p) * 100 + 1e-9), F.lit(98)))
    hist = rows.withColumn("bin", b.cast("int")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("k"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(98))))
    full = grid.join(hist, [*by, "bin"], "left").fillna(0, ["n", "k"])
    above = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    out = full.withColumns({"signals": F.sum("n").over(above), "correct": F.sum("k").over(above)}).filter(F.col("bin") >= 50)
    precision = [c.alias(name) for name, c in rate(F.col("correct"), F.col("signals"), "precision").items()]
    return out.select(*by, (F.col("bin") / 100).alias("threshold"), "candidates", "signals", "correct", *precision,
                      (F.col("signals") / F.col("candidates")).alias("coverage"))


def select_threshold(scored: DataFrame, by: Sequence[str] = (), target: float = 0.90, min_signals: int = 30, label: str = "label", p: str = "p") -> DataFrame:
    """The threshold of greatest coverage whose precision reaches the target (its lower bound may be
    five points below); else the one of highest precision, with a warning; else .85."""
    t = threshold_table(scored, by, label, p)
    enough = F.col("signals") >= min_signals
    ok = enough & (F.col("precision") >= target) & (F.col("precision_lo") >= target - 0.05)
    row = F.struct("threshold", "signals", "correct", "precision", "coverage")
    # Ties go to the lower threshold, which is met first.
    best = F.max_by(F.when(ok, row), F.when(ok, F.struct(F.col("coverage"), -F.col("threshold"))))
    fallback = F.max_by(F.when(enough, row), F.when(enough, F.struct(F.col("precision"), -F.col("threshold"))))
    out = t.groupBy(*by).agg(best.alias("_best"), fallback.alias("_fallback"))
    pick = F.coalesce("_best", "_fallback")
    return out.select(*by, F.coalesce(pick["threshold"], F.lit(0.85)).alias("threshold"), pick["signals"].alias("signals"),
                      pick["precision"].alias("precision"), pick["coverage"].alias("coverage"), F.col("_best").isNull().alias("warning"))


def holdout_status(m: DataFrame, target: float = 0.90, min_signals: int = 30) -> DataFrame:
    """Evidence ladder from metrics of a hold-out period."""
    status = (F.when(F.col("signals") < min_signals, "INSUFFICIENT_EVIDENCE")
              .when((F.col("precision") >= target) & (F.col("precision_lo") >= target - 0.05), "VERIFIED_ABOVE_90")
              .when(F.col("precision") >= target, "PROVISIONAL_ABOVE_90").otherwise("NOT_VERIFIED"))
    return m.withColumn("holdout_status", status)


def quarterly_precision(scored: DataFrame, threshold: float, min_signals: int = 5, label: str = "label", p: str = "p") -> DataFrame:
    """Signals and precision per quarter; NULL below five signals."""
    hit = F.col(p) >= threshold
    quarter = F.concat(F.year("d").cast("string"), F.lit("Q"), F.quarter("d").cast("string")).alias("quarter")
    out = scored.groupBy(quarter).agg(F.count_if(hit).alias("signals"), F.count_if(hit & (F.col(label) == 1)).alias("correct"))
    return out.withColumn("precision", F.when(F.col("signals") >= min_signals, F.col("correct") / F.col("signals")))


# ---- ensemble -----------------------------------------------------------------------------------

def members(runs: DataFrame) -> DataFrame:
    """The newest live run of each algorithm, with its weight (area under PR, at least .01)."""
    live = runs.filter(F.col("status").isin("ensemble_member", "active"))
    newest = scale.top_k(live, ["model_name"], [F.desc("run_id")], 1, rank="_k").drop("_k")
    return newest.withColumn("weight", F.greatest(F.coalesce(F.nullif(F.col("pr_auc"), F.lit(0.0)), F.lit(0.5)), F.lit(0.01)))


def supersede(runs: DataFrame) -> DataFrame:
    """Run lifecycle: of each algorithm's live runs only the newest stays live. One row per algorithm is joined back, so
    an algorithm with very many runs is no window of its own."""
    live = F.col("status").isin("ensemble_member", "active")
    newest = runs.filter(live).groupBy("model_name").agg(F.max("run_id").alias("_newest"))
    joined = runs.join(newest, "model_name", "left")
    return joined.withColumn("status", F.when(live & (F.col("run_id") < F.col("_newest")), "superseded").otherwise(F.col("status"))).select(*runs.columns)


def ensemble(long: DataFrame, keys: Sequence[str] = ("sym", "d")) -> DataFrame:
    """Confidence-weighted probability over the models that scored a row: sum(w p^3) / sum(w p^2).
    A model without a score is left out, not counted as zero."""
    p, weight = F.col("p"), F.greatest(F.col("weight"), F.lit(0.01))
    out = long.filter(p.isNotNull() & ~F.isnan(p)).groupBy(*keys).agg(
        F.try_divide(F.sum(weight * p * p * p), F.sum(weight * p * p)).alias("_p"), F.count(F.lit(1)).alias("models"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", F.round("p", 4))))).alias("breakdown"))
    return out.withColumn("probability", F.coalesce("_p", F.lit(0.0))).drop("_p")


RETRAIN_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}


def retrain_due(runs: DataFrame, schedule: str, now: Column, new_outcomes: int = 1) -> DataFrame:
    """One row: newest training time and whether the schedule and new outcomes call for another."""
    df = runs.agg(F.max("created_at").alias("last_trained"))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_trained")) / 86400)
    due = F.lit(False) if schedule == "manual" else F.coalesce(age >= RETRAIN_DAYS.get(schedule, 30), F.lit(False)) & F.lit(new_outcomes > 0)
    return df.withColumn("is_due", due)


# ---- index panel and direction --------------------------------------------------------------------

INDEX_FEATURES = ("ret_1", "ret_5", "ret_10", "ret_20", "ret_60", "rsi14", "macd_hist", "bb_pct", "vol20",
                  "from_sma20", "from_sma50", "from_sma200", "drawdown_pct")
MIN_TRAIN_ROWS, RETRAIN_EVERY = 300, 20


def index_panel(index_bars: DataFrame) -> DataFrame:
    """Technical panel per index: returns, distance to averages, MACD, RSI, %B, volatility, drawdown."""
    from .recurrences import with_recurrences
    df = w.with_pct_change(w.with_rn(index_bars.select("sym", "d", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")])))
    df = w.with_means(df, {f"sma{n}": ("close", n) for n in (20, 50, 200)})
    df = w.returns(df, (1, 5, 10, 20, 60), x="close")
    df = w.bollinger(df, ddof=1).drop("bb_position", "bb_squeeze", "bb_width")
    df = df.withColumns({"vol20": w.full(F.stddev_samp("pc").over(w.trail(20)), 21), "drawdown_pct": w.drawdown_ath()})
    df = df.withColumns({f"from_sma{n}": (F.col("close") / F.col(f"sma{n}") - 1) * 100 for n in (20, 50, 200)})
    return with_recurrences(df, [("rsi14", "rsi_ewm", {"n": 14}), ("macd", "macd", {"seed": "first"})])


def index_regime(panel: DataFrame) -> DataFrame:
    """Trend or volatility state of the index."""
    c, s50, s200, rsi = F.col("close"), F.col("sma50"), F.col("sma200"), F.col("rsi14")
    regime = (F.when(s50.isNull() | s200.isNull() | rsi.isNull(), "INSUFFICIENT_DATA").when(F.col("vol20") > 0.02, "HIGH_VOLATILITY")
              .when((c > s50) & (s50 > s200) & (rsi > 50), "TREND_UP").when((c < s50) & (s50 < s200) & (rsi < 50), "TREND_DOWN")
              .otherwise("SIDEWAYS"))
    return panel.withColumn("index_regime", regime)


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Balanced, ridge-penalised logistic coefficients (intercept first, not penalised) by Newton steps."""
    n, ones = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    z = np.column_stack([np.ones(n), x])
    ridge = np.eye(z.shape[1])
    ridge[0, 0] = 0.0
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge @ beta
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + ridge
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit_points(ok: np.ndarray, up: np.ndarray, h: int, min_train: int, every: int) -> np.ndarray:
    """For each row the row at which the model that scores it is fitted, or -1.

    A model is fitted on every ``every``-th row from ``min_train`` on, if that row is usable, and on any usable row while
    there is none. It learns from the usable rows whose outcome was known before the row, ``h`` earlier at least; with
    fewer than 30 of them the model before stays, with outcomes of one kind there is none. Only counts decide, so
    every task can tell which models it needs without fitting those of others."""
    labelled = ok & ~np.isnan(up)
    seen = np.r_[0, np.cumsum(labelled)]
    rises = np.r_[0, np.cumsum(labelled & (up == 1))]
    out, model = np.full(len(ok), -1), -1
    for t in range(min_train, len(ok)):
        if not ok[t]:
            continue
        if model < 0 or (t - min_train) % every == 0:
            known, ones = seen[max(t - h, 0)], rises[max(t - h, 0)]
            if known >= 30:
                model = t if 0 < ones < known else -1
        out[t] = model
    return out


def index_direction(panel: DataFrame, horizons: Sequence[int] = (5, 60), min_train: int = MIN_TRAIN_ROWS, every: int = RETRAIN_EVERY,
                    per_task: int = 10) -> DataFrame:
    """Probability that the close is higher h sessions on, by an expanding-window logistic model that is refitted every
    20 sessions on labels known by then (see ``fit_points``).

    Indices, horizons and stretches of ``per_task`` refits are independent tasks: a stretch gets the index's sessions up
    to its end and fits its own models only. A session is thus sent once per later stretch, at most
    sessions / (every * per_task) times."""
    cols = list(INDEX_FEATURES)
    usable = F.lit(True)
    for c in cols:
        usable = usable & F.col(c).isNotNull()
    df = panel.withColumns({"i": F.col("rn") - 1, "ok": usable, "last": F.max("rn").over(w.all_rows()) - 1})
    df = df.withColumns({f"_ahead_{h}": F.lead("close", h).over(w.by_date()) for h in horizons})
    up = [F.struct(F.lit(h).alias("h"), (F.col(f"_ahead_{h}") > F.col("close")).cast("double").alias("up")) for h in horizons]
    df = df.withColumn("_up", F.explode(F.array(*up))).select("sym", "_up.h", "d", "i", "ok", "_up.up", "last", *cols)
    width = every * per_task
    first = F.greatest(F.lit(0), F.floor((F.col("i") - min_train) / width)).cast("int")
    final = F.floor((F.col("last") - min_train) / width).cast("int")
    df = df.where(final >= 0).withColumn("stretch", F.explode(F.sequence(first, final))).drop("last")

    def per_stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        h, x, y, ok = int(pdf["h"].iloc[0]), pdf[cols].to_numpy(float), pdf["up"].to_numpy(float), pdf["ok"].to_numpy(bool)
        models = fit_points(ok, y, h, min_train, every)
        models[:min_train + int(pdf["stretch"].iloc[0]) * width] = -1  # rows of other stretches
        p = np.full(len(pdf), np.nan)
        for t in np.unique(models[models >= 0]):
            known = ok[:t - h] & ~np.isnan(y[:t - h])
            train = x[:t - h][known]
            mean, dev = train.mean(axis=0), train.std(axis=0)
            dev[dev == 0] = 1.0
            beta = _fit_logistic((train - mean) / dev, y[:t - h][known])
            rows = np.flatnonzero(models == t)
            p[rows] = 1 / (1 + np.exp(-(((x[rows] - mean) / dev) @ beta[1:] + beta[0])))
        out = pdf[["sym", "h", "d"]].assign(p_up=p, up=y)
        return out[~np.isnan(p)]

    out = df.groupBy("sym", "h", "stretch").applyInPandas(per_stretch, "sym string, h int, d date, p_up double, up double")
    return out.withColumn("up", F.when(~F.isnan("up"), F.col("up")))


def direction_summary(scored: DataFrame) -> DataFrame:
    """Hit rate of the direction calls whose outcome is known."""
    known = scored.filter(F.col("up").isNotNull())
    hit = (F.col("p_up") >= 0.5) == (F.col("up") == 1)
    out = known.groupBy("sym", "h").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumns(rate(F.col("hits"), F.col("n"), "hit")).withColumnRenamed("hit", "hit_rate")


def drawdown_analog(panel: DataFrame, window: int = 20, band: float = 5.0) -> DataFrame:
    """Per index: today's drawdown, how rare it is, and how many sessions it took from days of similar
    drawdown to the next local bottom (count, median, least, most)."""
    df = panel.withColumns({"bottom": w.local_bottoms(window), "n": F.count(F.lit(1)).over(w.all_rows()),
                            "now": F.last("drawdown_pct").over(w.all_rows())})
    # The next bottom is carried back in one reverse pass: the least later row number with a bottom.
    back = Window.partitionBy("sym").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("next_bottom", F.min(F.when(F.col("bottom"), F.col("rn"))).over(back))
    similar = F.col("drawdown_pct").between(F.col("now") - band, F.col("now") + band)
    inside = (F.col("rn") > window) & (F.col("rn") <= F.col("n") - window)
    steps = F.when(similar & inside, F.col("next_bottom") - F.col("rn"))
    return df.groupBy("sym").agg(
        F.max("now").alias("current_drawdown_pct"),
        (F.avg((F.col("drawdown_pct") >= F.col("now")).cast("int")) * 100).alias("drawdown_percentile"),
        F.count(steps).alias("similar_episodes"), F.floor(F.percentile(steps, 0.5)).alias("median_sessions"),
        F.min(steps).alias("min_sessions"), F.max(steps).alias("max_sessions"))
