"""Features, labels, signals, models and index analysis."""

import datetime as dt
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkbars.functions.dates import market_calendar
from sparkbars.operators import feature_arrays
from sparkbars.operators import features as ft
from sparkbars.operators import labels as lb
from sparkbars.operators import models as ml
from sparkbars.operators import signals as sg
from sparkbars.operators import snapshot as sn
from sparkbars.operators import windows as w
from sparkbars.sources.trades import densify


@pytest.fixture(scope="module")
def feats(bars):
    df = ft.features(bars).persist()
    yield df
    df.unpersist()


def test_feature_names():
    names = ft.feature_names()
    assert len(names) == len(set(names)) == 129


def test_features_match_pandas(feats, walk):
    got = feats.filter("sym = 'AAAA'").toPandas().sort_values("d", ignore_index=True)
    b = walk[walk.sym == "AAAA"].sort_values("d", ignore_index=True)
    c, v = b["close"], b["volume"].astype(float)
    pc = c.pct_change()
    delta = c.diff()
    gain, loss = delta.clip(lower=0), (-delta).clip(lower=0)
    rs = gain.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / loss.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    mid, sd = c.rolling(20).mean(), c.rolling(20).std()
    obv = (np.sign(delta) * v).cumsum()
    width = 4 * sd / mid
    want = {
        "return_5d": c / c.shift(5) - 1, "sma200": c.rolling(200).mean(), "ema50": c.ewm(span=50, adjust=False, min_periods=50).mean(),
        "rsi14": 100 - 100 / (1 + rs), "hvol60": pc.rolling(60).std() * math.sqrt(252), "downside_vol20": pc.where(pc < 0, 0).rolling(20).std() * math.sqrt(252),
        "close_vs_high_252d": (c / c.rolling(252).max() - 1).where(b.index >= 252), "bb_width": width, "rel_volume_20d": (v / v.rolling(20).mean()).where(b.index >= 20),
        "obv_vs_ma20": (obv - obv.rolling(20).mean()) / obv.rolling(20).mean().abs(), "vol_price_corr_5d": v.rolling(5).corr(c), "sma20_slope": mid / mid.shift(5) - 1,
    }
    for name, x in want.items():
        x = x.to_numpy(float)[4:]
        if name == "downside_vol20":
            x[:16] = np.nan
        np.testing.assert_allclose(got[name].to_numpy(float), x, rtol=1e-6, atol=1e-9, equal_nan=True, err_msg=name)


def test_features_do_not_look_ahead(bars, feats):
    cut = F.lit("2024-11-15").cast("date")
    past = ft.features(bars.filter(F.col("d") <= cut))
    rounded = lambda df: df.filter(F.col("d") <= cut).select("sym", "d", *[F.round(c, 8).alias(c) for c in ft.feature_names()])
    assert rounded(feats).exceptAll(rounded(past)).count() == 0


def test_only_inputs_are_features(feats, bars):
    data = lb.dataset(feats, lb.labels_fast(bars))
    cols = ft.feature_cols(data)
    assert set(cols) == set(ft.feature_names())
    assert lb.leakage(data, cols) == []


def brute_labels(walk, h=5):
    """The definition, one symbol and date at a time, on the market's sessions."""
    days = sorted(walk["d"].unique())
    at = {(r.sym, r.d): r for r in walk.itertuples()}
    out = {}
    for r in walk.itertuples():
        i = days.index(r.d)
        if i + h >= len(days):
            out[r.sym, r.d] = None
            continue
        future = [at.get((r.sym, days[i + k])) for k in range(1, h + 1)]
        if future[-1] is None:
            continue
        entry = future[0].open if future[0] is not None and future[0].open > 0 else r.close
        ret = future[-1].close / entry - 1
        tp = next((k for k, f in enumerate(future) if f is not None and f.high >= entry * 1.03), None)
        sl = next((k for k, f in enumerate(future) if f is not None and f.low <= entry * 0.98), None)
        hit = (1 if ret >= 0 else 0) if tp is None and sl is None else int(sl is None or (tp is not None and tp < sl))
        out[r.sym, r.d] = (ret, int(ret >= 0.02), hit)
    return out


def test_labels_match_the_definition(spark, walk):
    gaps = walk[~((walk.sym == "BBBB") & (walk.index % 7 == 0))]  # a symbol that misses sessions
    got = {(r.sym, r.d): r for r in lb.labels(spark.createDataFrame(gaps)).collect()}
    want = brute_labels(gaps)
    assert got.keys() == want.keys()
    for key, x in want.items():
        r = got[key]
        if x is None:
            assert r.is_inference and r.label is None
        else:
            assert math.isclose(r.trade_return, x[0], rel_tol=1e-12) and (r.label, r.tp_sl_success) == x[1:]


def test_training_window_is_the_next_h_bars(spark):
    rows = [("A", i, 100.0, 100.0, 100.0) for i in range(6)] + [("A", 6, 100.0, 200.0, 100.0)] + [("A", i, 100.0, 100.0, 100.0) for i in range(7, 15)]
    df = spark.createDataFrame(rows, "sym string, d int, close double, high double, low double")
    fast = {r.d: r.label for r in lb.labels_fast(df).collect()}
    assert [d for d, y in fast.items() if y == 1] == [1, 2, 3, 4, 5]
    legacy = {r.d: r.label for r in lb.labels_fast(df, legacy_window=True).collect()}
    assert [d for d, y in legacy.items() if y == 1] == [0, 1, 2]


def test_dense_grid(spark):
    df = spark.createDataFrame([("A", "2026-01-05", 10.0, 5, 7.0), ("A", "2026-01-07", 11.0, 6, 9.0), ("B", "2026-01-06", 3.0, 1, 1.0), ("B", "2026-01-08", 4.0, 1, 1.0)],
                               "sym string, d string, close double, volume long, high double").withColumn("d", F.to_date("d"))
    got = [(r.sym, str(r.d), r.close, r.volume, r.high) for r in densify(df).orderBy("sym", "d").collect()]
    assert got == [("A", "2026-01-05", 10.0, 5, 7.0), ("A", "2026-01-06", 10.0, 0, 0.0), ("A", "2026-01-07", 11.0, 6, 9.0), ("A", "2026-01-08", 11.0, 0, 0.0),
                   ("B", "2026-01-06", 3.0, 1, 1.0), ("B", "2026-01-07", 3.0, 0, 0.0), ("B", "2026-01-08", 4.0, 1, 1.0)]
    assert market_calendar(df).count() == 4


def test_snapshot_sum_of_components(bars):
    snap = sn.snapshot(bars, per="sym").collect()
    assert len(snap) == 3
    for r in snap:
        assert r.score == sum(p.points for p in r.score_parts) and r.score_coverage == 100
        assert all(not p.passed or p.available for p in r.score_parts)


def test_market_snapshot_needs_the_newest_date(bars):
    assert [r.sym for r in sn.snapshot(bars).select("sym").collect()] == ["AAAA"]


def test_signal_plans_are_sound(bars):
    rows = sg.trade_plan(sg.score(sg.indicators(bars, last_only=False))).collect()
    assert rows
    for r in rows:
        assert r.sl < r.close < r.tp and r.rr_ratio >= 1.2 and 40 <= r.score <= 100 and r.points <= r.possible and len(r.reasons) <= 4


def index_frame(spark, values, start="2018-01-01", sym="COMPOSITE"):
    days = pd.bdate_range(start, periods=len(values))
    return spark.createDataFrame([(sym, d.date(), float(v) * 1.002, float(v) * 0.998, float(v)) for d, v in zip(days, values)], "sym string, d date, high double, low double, close double")


def test_local_bottom_of_a_v(spark):
    values = np.concatenate([np.linspace(200, 101, 100), np.linspace(102, 201, 100)])
    df = w.with_rn(index_frame(spark, values)).withColumn("b", w.local_bottoms(20)).filter("b")
    assert [r.rn - 1 for r in df.collect()] == [99]


def test_deep_drawdown_is_rare(spark):
    values = np.concatenate([np.linspace(1000, 2000, 500), np.linspace(2000, 1300, 60)])
    r = ml.drawdown_analog(w.with_rn(index_frame(spark, values)).withColumn("drawdown_pct", w.drawdown_ath())).first()
    assert r.current_drawdown_pct < -20 and r.drawdown_percentile > 90


def test_index_direction_on_a_drift(spark):
    rng = np.random.default_rng(11)
    values = 1000 * np.exp(np.cumsum(rng.normal(0.0009, 0.009, 700)))
    scored = ml.index_direction(ml.index_panel(index_frame(spark, values)))
    got = {r.h: r for r in ml.direction_summary(scored).collect()}
    assert set(got) == {5, 60} and got[5].n > 200 and 0 <= got[60].hit_lo <= got[60].hit_rate <= got[60].hit_hi <= 1
    assert ml.index_direction(ml.index_panel(index_frame(spark, values[:200]))).count() == 0
    unresolved = scored.filter("h = 5 and up is null").count()
    assert unresolved == 5


def test_index_direction_does_not_look_ahead(spark):
    rng = np.random.default_rng(5)
    values = 1000 * np.exp(np.cumsum(rng.normal(0.0005, 0.01, 520)))
    a = {(r.h, r.d): r.p_up for r in ml.index_direction(ml.index_panel(index_frame(spark, values))).collect()}
    b = {(r.h, r.d): r.p_up for r in ml.index_direction(ml.index_panel(index_frame(spark, values[:450]))).collect()}
    assert b and all(math.isclose(a[k], v, rel_tol=1e-9) for k, v in b.items())


def test_index_direction_equals_the_serial_schedule(spark):
    """Row by row, as one would do it by hand: holes in the features, on and off the schedule."""
    rng = np.random.default_rng(21)
    values = 1000 * np.exp(np.cumsum(rng.normal(0.0003, 0.012, 520)))
    panel = ml.index_panel(index_frame(spark, values))
    holes = panel.withColumn("rsi14", F.when(~(F.col("rn") - 1).isin(330, 331, 350, 351, 352, 400), F.col("rsi14"))).persist()
    got = {(r.h, r.d): r for r in ml.index_direction(holes, min_train=250, every=20, per_task=3).collect()}
    rows = holes.orderBy("d").toPandas()
    cols = list(ml.INDEX_FEATURES)
    x = rows[cols].to_numpy(float)
    ok, close = ~np.isnan(x).any(axis=1), rows["close"].to_numpy(float)
    want = {}
    for h in (5, 60):
        y = np.r_[(close[h:] > close[:-h]).astype(float), np.full(h, np.nan)]
        model = None
        for t in range(250, len(rows)):
            if not ok[t]:
                continue
            if model is None or (t - 250) % 20 == 0:
                known = ok[:t - h] & ~np.isnan(y[:t - h])
                if known.sum() >= 30:
                    a, b = x[:t - h][known], y[:t - h][known]
                    model = (a.mean(axis=0), a.std(axis=0), ml._fit_logistic((a - a.mean(axis=0)) / a.std(axis=0), b)) if len(set(b)) == 2 else None
            if model is not None:
                z = np.r_[1.0, (x[t] - model[0]) / model[1]] @ model[2]
                want[h, rows["d"][t]] = 1 / (1 + math.exp(-z))
    assert set(got) == set(want) and len(want) > 300
    assert all(math.isclose(got[k].p_up, v, rel_tol=1e-9) for k, v in want.items())
    holes.unpersist()


def test_logistic_coefficients():
    """Balanced classes with a ridge: the gradient of the stated objective vanishes, and separable data stay finite."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.5, -2.0, 0.0] + rng.logistic(size=400) > 0.7).astype(float)
    beta = ml._fit_logistic(x, y)
    weight = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum()))
    p = 1 / (1 + np.exp(-(np.column_stack([np.ones(400), x]) @ beta)))
    assert np.allclose(np.column_stack([np.ones(400), x]).T @ (weight * (p - y)) + np.r_[0, beta[1:]], 0, atol=1e-6)
    assert np.allclose(beta[1:], [1.5, -2.0, 0.0], atol=0.5)
    assert np.isfinite(ml._fit_logistic(x, (x[:, 0] > 0).astype(float))).all()


def test_folds(spark):
    got = ml.folds(spark, "2020-01-01", "2023-12-31").orderBy("fold").collect()
    assert (got[0].train_end, got[0].val_start, got[0].val_end) == (dt.date(2022, 1, 1), dt.date(2022, 1, 6), dt.date(2022, 4, 6))
    assert all((f.val_start - f.train_end).days == 5 and f.val_end <= dt.date(2023, 12, 31) for f in got) and len(got) == 8


def test_training_rows_leave_before_validation(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 1400)]
    rng = np.random.default_rng(4)
    rows = [(f"S{s}", d, d + dt.timedelta(days=5 if s else 60), int(x > 0.5), float(x), 0.0) for s in range(2) for d, x in zip(days, rng.uniform(0, 1, len(days)))]
    df = spark.createDataFrame(rows, "sym string, d date, exit_date date, label int, f double, trade_return double")
    table = ml.folds(spark, "2020-01-01", "2023-10-31", 24, 3, 5, 6)
    bounds = {f.fold: f for f in table.collect()}
    for embargo in (0, 10):
        counts = {r.fold: r for r in ml.fold_rows(df, table, embargo).collect()}
        assert set(counts) == set(bounds)
        for k, f in bounds.items():
            inside = [r for r in rows if f.train_start <= r[1] <= f.train_end]
            kept = [r for r in inside if r[2] < f.val_start - dt.timedelta(days=embargo)]
            assert (counts[k].n_train, counts[k].n_purged) == (len(kept), len(inside) - len(kept)) and counts[k].n_purged > 50
            assert counts[k].last_exit == max(r[2] for r in kept) < f.val_start
            assert counts[k].n_val == sum(f.val_start <= r[1] <= f.val_end for r in rows)
    scored = ml.walk_forward(df, table.filter("fold < 2"), ["f"]).collect()
    assert {r.fold for r in scored} == {0, 1} and len(scored) == sum(counts[k].n_val for k in (0, 1))
    assert np.mean([(r.p > 0.5) == r.label for r in scored]) > 0.9


def test_fold_rules(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), dt.date(2020, 1, 3) + dt.timedelta(days=i), i % 2, float(i % 2), 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "sym string, d date, exit_date date, label int, f double, trade_return double")
    none = ml.folds(spark, "2020-01-01", "2020-10-01")
    assert none.count() == 0
    single = ml.walk_forward(df, none, ["f"], fallback=("2020-01-01", "2020-06-30", "2020-07-05", "2020-08-31"))
    assert {r.fold for r in single.collect()} == {0} and single.count() == 58
    few = ml.folds(spark, "2020-01-01", "2020-07-20", 6, 3)  # fewer than 20 validation rows
    with pytest.raises(ValueError):
        ml.walk_forward(df, few, ["f"])
    with pytest.raises(ValueError):
        ml.walk_forward(df.withColumn("label", (F.col("d") > "2020-01-06").cast("int")), none, ["f"], fallback=("2020-01-01", "2020-06-30", "2020-07-05", "2020-08-31"))
    assert ml.folds(spark, "1700-01-01", "2020-12-31").count() > 1201


def test_interval_of_a_proportion(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (7, 10), (10, 10), (500, 900)], "k long, n long")
    for r in df.withColumns(ml.rate(F.col("k"), F.col("n"), "r")).collect():
        if not r.n:
            assert (r.r, r.r_lo, r.r_hi) == (0, 0, 1)
            continue
        for q in (r.r_lo, r.r_hi):
            assert q in (0, 1) or math.isclose((r.k / r.n - q) ** 2, 1.96 ** 2 * q * (1 - q) / r.n, rel_tol=1e-9, abs_tol=1e-12)
        assert 0 <= r.r_lo <= r.r <= r.r_hi <= 1


def test_calibration_of_pooled_scores(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 1, 5000)
    df = spark.createDataFrame([(float(x), int(rng.uniform() < x ** 2)) for x in p], "p double, label int")
    got = ml.calibrate(df).transform(spark.createDataFrame([(0.3,), (0.9,)], "p double")).orderBy("p").collect()
    assert abs(got[0].p_calibrated - 0.09) < 0.08 and abs(got[1].p_calibrated - 0.81) < 0.08


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(0.5 + 0.2 * (y - 0.5) + rng.normal(0, 0.2, 400), 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, p, rng.normal(0, 0.02, 400))], "label int, p double, trade_return double")
    m = ml.metrics(df, 0.6).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    steps = [((p >= t) & (y == 1)).sum() for t in sorted(set(p), reverse=True)]
    prec = [((p >= t) & (y == 1)).sum() / (p >= t).sum() for t in sorted(set(p), reverse=True)]
    ap = sum((k - j) / y.sum() * q for j, k, q in zip([0, *steps], steps, prec))
    assert math.isclose(m.roc_auc, auc) and math.isclose(m.pr_auc, ap) and m.signals == (p >= 0.6).sum()
    assert math.isclose(m.precision, y[p >= 0.6].mean()) and math.isclose(m.brier, np.mean((p - y) ** 2))
    table = {round(r.threshold, 2): r for r in ml.threshold_table(df).collect()}
    assert len(table) == 49 and all(r.signals == (np.round(p * 100) >= round(t * 100)).sum() for t, r in table.items())
    best = ml.select_threshold(df, target=0.7).first()
    ok = [t for t, r in table.items() if r.signals >= 30 and r.precision >= 0.7 and r.precision_lo >= 0.65]
    assert (best.threshold == min(ok)) if ok else best.warning


@pytest.mark.parametrize("name", ml.MODELS)
def test_pipelines_learn(spark, name):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 2))
    y = (x[:, 0] + 0.3 * rng.normal(0, 1, 400) > 0.4).astype(int)
    rows = [(int(b), None if i % 37 == 0 else float(a[0]), float(a[1])) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "label int, f1 double, f2 double")
    fitted = ml.make_pipeline(name, ["f1", "f2"]).fit(ml.with_class_weights(df))
    assert ml.metrics(ml.score(fitted, df), 0.5).first().roc_auc > 0.85


def test_wanted_features_alone(bars, feats):
    """A model that reads three features does not pay for 129: values as in the full table, nothing else goes through the grouped map."""
    names = ["rsi14", "macd_bullish", "rel_volume_20d", "ma_aligned_bull", "golden_cross", "close_vs_ema5"]
    got = ft.features(bars, names)
    assert set(got.columns) == {"sym", "d", "close", "rn", *names}
    a = got.orderBy("sym", "d").toPandas()
    b = feats.select(*got.columns).orderBy("sym", "d").toPandas()
    pd.testing.assert_frame_equal(a, b)
    few = ft.features(bars, ["rsi14", "return_5d"])
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "ema5" not in plan and "hvol20" not in plan and "FlatMapGroupsInArrow" in plan
    assert "FlatMapGroupsInArrow" not in ft.features(bars, ["return_5d"])._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="unknown"):
        ft.features(bars, ["return_7d"])


def test_whole_table_is_one_pass(spark, walk):
    """All 129 features come from the bars in one pass with no window but the row number, and equal the native columns, with prices
    missing, flat prices, idle days, and symbols of one to a few hundred rows."""
    odd = walk.drop(columns=["prev", "change", "shares"]).astype({"volume": float, "freq": float})
    for sym, n in (("D", 1), ("E", 4), ("F", 5), ("G", 27)):
        odd = pd.concat([odd, walk[walk.sym == "AAAA"].head(n).assign(sym=sym)[odd.columns]], ignore_index=True)
    rng = np.random.default_rng(5)
    for x in ("open", "high", "low", "close", "volume", "value"):
        odd.loc[(odd.sym == "BBBB") & (rng.random(len(odd)) < 0.06), x] = np.nan
    odd.loc[odd[odd.sym == "CCCC"].index[40:80], ["open", "high", "low", "close"]] = 50.0
    odd.loc[odd[odd.sym == "CCCC"].index[100:130], ["volume", "fbuy"]] = 0.0
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in odd.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, ", ".join(f"{x} {'string' if x == 'sym' else 'date' if x == 'd' else 'double'}" for x in odd.columns))
    whole = ft.features(df)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and "MapInArrow" in plan and "FlatMapGroups" not in plan
    a, b = (x.toPandas().sort_values(["sym", "d"], ignore_index=True) for x in (whole, ft.features(df, ft.feature_names())))
    assert len(a) == sum(max(0, n - 4) for n in odd.groupby("sym").size())
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)


def test_symbols_stay_whole_over_batches():
    """Batches end in the middle of symbols; a symbol longer than a table is not cut."""
    sizes = (3, 40, 7, 200, 1, 1, 12)
    rn = np.concatenate([np.arange(1, n + 1) for n in sizes])
    sym = np.repeat([f"S{i}" for i in range(len(sizes))], sizes)
    table = pa.table({"sym": sym, "d": rn, **{x: rn + 0.5 for x in feature_arrays.INPUTS}, "rn": rn})
    parts = list(feature_arrays.whole_symbols(iter(table.to_batches(max_chunksize=11)), 30))
    assert len(parts) > 2 and pa.concat_tables(parts).equals(table)
    assert all(p["rn"][0].as_py() == 1 for p in parts)
    names = ["return_1d", "sma5"]
    got = pa.Table.from_batches([b for p in parts for b in feature_arrays.by_symbols(p, ft.feature_names(), ft.SHAPE, ft.VOLUME_BLOCK, 5)])
    want = {(s, r): (1 / (r - 0.5), r - 1.5) for s, r in zip(sym.tolist(), rn.tolist()) if r >= 5}
    assert {(s, r): pytest.approx(v) for s, r, *v in zip(*(got[c].to_pylist() for c in ("sym", "rn", *names)))} == {k: list(v) for k, v in want.items()}
