"""Parabolic stops, candlesticks, rotation, seasonality, derived distances and anomaly proxies against plain definitions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkbars.operators import patterns as p
from sparkbars.operators.recurrences import sar, with_recurrences

DAY = dt.date(2025, 1, 6)


def by_definition(rows, rule, start=0.02, step=0.02, top=0.2):
    """Parabolic stops written as a trade log: every trade has a direction, and a list of stops until one is hit."""
    out, high, low = [None], [r[0] for r in rows], [r[1] for r in rows]
    close = [r[2] for r in rows]
    if len(rows) < 2:
        return out[:len(rows)]
    rise = close[1] >= close[0] if rule == "close" else (low[0] - low[1]) <= max(high[1] - high[0], 0)
    trade = {"way": 1 if rise else -1, "speed": start, "best": max(high[:2]) if rise else min(low[:2]), "stop": low[0] if rise else high[0]}
    out.append((trade["stop"], trade["way"]))
    for i in range(2, len(rows)):
        stop = trade["stop"] + trade["speed"] * (trade["best"] - trade["stop"])
        if trade["way"] == 1:
            stop = min([stop, *low[i - 2:i]])
            if low[i] < stop:
                trade = {"way": -1, "speed": start, "best": low[i], "stop": max(trade["best"], *high[i - 1:i + 1])}
            else:
                if high[i] > trade["best"]:
                    trade.update(best=high[i], speed=min(top, trade["speed"] + step))
                trade["stop"] = stop
        else:
            stop = max([stop, *high[i - 2:i]])
            if high[i] > stop:
                trade = {"way": 1, "speed": start, "best": high[i], "stop": min(trade["best"], *low[i - 1:i + 1])}
            else:
                if low[i] < trade["best"]:
                    trade.update(best=low[i], speed=min(top, trade["speed"] + step))
                trade["stop"] = stop
        out.append((trade["stop"], trade["way"]))
    return out


@pytest.mark.parametrize("rule", ["close", "moves"])
def test_parabolic_stops(spark, walk, rule):
    df = spark.createDataFrame(walk[["sym", "d", "high", "low", "close"]])
    got = with_recurrences(df, [("p", "sar", {"rule": rule})]).orderBy("sym", "d").toPandas()
    for sym, part in walk.groupby("sym"):
        want = by_definition(part[["high", "low", "close"]].to_numpy().tolist(), rule)
        mine = got[got["sym"] == sym]
        assert len({w[1] for w in want if w}) == 2
        for a, b, w in zip(mine["p_sar"], mine["p_trend"], want):
            assert (w is None and math.isnan(a)) or (math.isclose(a, w[0], rel_tol=1e-12) and b == w[1])


def test_parabolic_start_rules_and_gaps():
    frame = lambda rows: pd.DataFrame(rows, columns=["high", "low", "close"], dtype=float)
    rows = [(10, 9, 9.2), (10.1, 8, 9.5), (10.3, 9, 10)]
    assert sar(frame(rows))["trend"].tolist()[1:] == [1, 1] and sar(frame(rows), rule="moves")["trend"].tolist()[1] == -1
    assert sar(frame(rows[:1]))["sar"].isna().all() and sar(frame([]))["sar"].empty
    holed = [rows[0], (None, 8, 9), rows[1], rows[2]]
    a, b = sar(frame(rows)), sar(frame(holed))
    assert b["sar"].tolist()[2:] == a["sar"].tolist()[1:] and math.isnan(b["sar"][1])
    with pytest.raises(ValueError):
        sar(frame(rows), rule="x")


# Per pattern: what went before, bars relative to the last close that make it, and bars that just miss it.
CANDLES = {
    "doji": ("fell", [(0, .5, -.5, .02)], [(0, .5, -.5, .2)]),
    "dragonfly_doji": ("fell", [(0, .02, -1, 0)], [(0, .5, -.5, 0)]),
    "gravestone_doji": ("rose", [(0, 1, -.02, 0)], [(0, .5, -.5, 0)]),
    "long_legged_doji": ("rose", [(0, 1.2, -1.2, .05)], [(0, .9, -.9, .05)]),
    "white_marubozu": ("fell", [(0, 2.02, -.02, 2)], [(0, 2.3, -.02, 2)]),
    "black_marubozu": ("rose", [(0, .02, -2.02, -2)], [(0, .3, -2.02, -2)]),
    "hammer": ("fell", [(0, .32, -1, .3)], [(0, .32, -.5, .3)]),
    "hanging_man": ("rose", [(0, .32, -1, .3)], [(0, .32, -.5, .3)]),
    "inverted_hammer": ("fell", [(0, 1.3, -.02, .3)], [(0, .8, -.02, .3)]),
    "shooting_star": ("rose", [(0, 1.3, -.02, .3)], [(0, .8, -.02, .3)]),
    "bullish_engulfing": ("fell", [(0, .1, -1.1, -1), (-1.1, .2, -1.2, .1)], [(0, .1, -1.1, -1), (-1.1, 0, -1.2, -.1)]),
    "bearish_engulfing": ("rose", [(0, 1.1, -.1, 1), (1.1, 1.2, -.2, -.1)], [(0, 1.1, -.1, 1), (1.1, 1.2, -.05, .1)]),
    "bullish_harami": ("fell", [(0, .1, -2.1, -2), (-1.5, -1.2, -1.6, -1.3)], [(0, .1, -2.1, -2), (-2.2, -1.9, -2.3, -2)]),
    "bearish_harami": ("rose", [(0, 2.1, -.1, 2), (1.5, 1.6, 1.2, 1.3)], [(0, 2.1, -.1, 2), (2, 2.3, 1.9, 2.2)]),
    "piercing_line": ("fell", [(0, .1, -1.1, -1), (-1.3, -.2, -1.4, -.3)], [(0, .1, -1.1, -1), (-1.3, -.5, -1.4, -.6)]),
    "dark_cloud_cover": ("rose", [(0, 1.1, -.1, 1), (1.3, 1.4, .2, .3)], [(0, 1.1, -.1, 1), (1.3, 1.4, .5, .6)]),
    "tweezer_bottom": ("fell", [(0, .1, -1.1, -1), (-.9, -.2, -1.1, -.3)], [(0, .1, -1.1, -1), (-.9, -.2, -1, -.3)]),
    "tweezer_top": ("rose", [(0, 1.1, -.1, 1), (.9, 1.1, .2, .3)], [(0, 1.1, -.1, 1), (.9, 1, .2, .3)]),
    "morning_star": ("fell", [(0, .1, -2.1, -2), (-2.5, -2.3, -2.8, -2.6), (-2.3, -.4, -2.4, -.5)],
                     [(0, .1, -2.1, -2), (-2.5, -2.3, -2.8, -2.6), (-2.3, -1.1, -2.4, -1.2)]),
    "evening_star": ("rose", [(0, 2.1, -.1, 2), (2.5, 2.8, 2.3, 2.6), (2.3, 2.4, .4, .5)], [(0, 2.1, -.1, 2), (2.5, 2.8, 2.3, 2.6), (2.3, 2.4, 1.1, 1.2)]),
    "three_white_soldiers": ("fell", [(0, 1.1, -.1, 1), (.5, 1.7, .4, 1.6), (1.1, 2.3, 1, 2.2)], [(0, 1.1, -.1, 1), (.5, 1.7, .4, 1.6), (1.7, 2.9, 1.6, 2.8)]),
    "three_black_crows": ("rose", [(0, .1, -1.1, -1), (-.5, -.4, -1.7, -1.6), (-1.1, -1, -2.3, -2.2)],
                          [(0, .1, -1.1, -1), (-.5, -.4, -1.7, -1.6), (-1.7, -1.6, -2.9, -2.8)]),
    "three_inside_up": ("fell", [(0, .1, -2.1, -2), (-1.5, -1.2, -1.6, -1.3), (-1.2, .3, -1.3, .2)],
                        [(0, .1, -2.1, -2), (-1.5, -1.2, -1.6, -1.3), (-1.2, 0, -1.3, -.1)]),
    "three_inside_down": ("rose", [(0, 2.1, -.1, 2), (1.5, 1.6, 1.2, 1.3), (1.2, 1.3, -.3, -.2)], [(0, 2.1, -.1, 2), (1.5, 1.6, 1.2, 1.3), (1.2, 1.3, 0, .1)]),
    "three_outside_up": ("fell", [(0, .1, -1.1, -1), (-1.1, .2, -1.2, .1), (.1, .6, 0, .5)], [(0, .1, -1.1, -1), (-1.1, .2, -1.2, .1), (0, .2, -.1, .05)]),
    "three_outside_down": ("rose", [(0, 1.1, -.1, 1), (1.1, 1.2, -.2, -.1), (-.1, 0, -.6, -.5)], [(0, 1.1, -.1, 1), (1.1, 1.2, -.2, -.1), (0, .1, -.1, -.05)]),
}


def test_each_candlestick_and_a_near_miss(spark):
    assert set(CANDLES) == set(p.PATTERNS) and len(CANDLES) == 26
    rows = []
    for name, (before, *cases) in CANDLES.items():
        for kind, bars in zip(("hit", "miss", "flat"), (*cases, cases[0])):
            way = {"fell": -1, "rose": 1}[before] * (-1 if kind == "flat" else 1)  # flat: the other direction before
            lead = [(way * i, way * i + max(way, 0) + .2, way * i + min(way, 0) - .2, way * (i + 1)) for i in range(15)]
            base = lead[-1][3]
            for i, bar in enumerate([*lead, *(tuple(base + x for x in b) for b in bars)]):
                rows.append((f"{name}/{kind}", DAY + dt.timedelta(days=i), *(100.0 + x for x in bar)))
    df = spark.createDataFrame(rows, "sym string, d date, open double, high double, low double, close double")
    ends = df.groupBy("sym").agg(F.max("d").alias("d"))
    found = {}
    for r in p.candle_events(df).join(ends, ["sym", "d"]).collect():
        found.setdefault(r.sym, set()).add(r.pattern)
    for name, (before, *_) in CANDLES.items():
        assert name in found.get(f"{name}/hit", ()), (name, found.get(f"{name}/hit"))
        assert name not in found.get(f"{name}/miss", ()), name
        needs = "fell" in p.PATTERNS[name][2] or "rose" in p.PATTERNS[name][2]
        assert (name in found.get(f"{name}/flat", ())) is not needs, name


def test_candles_without_prices_or_history(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.0) for i in range(10)] + [("B", DAY + dt.timedelta(days=i), None if i == 12 else 1.0, 2.0, 0.5, 1.0) for i in range(13)]
    df = spark.createDataFrame(rows, "sym string, d date, open double, high double, low double, close double")
    assert {(r.sym, (r.d - DAY).days) for r in p.candle_events(df).collect()} == {("B", 10), ("B", 11)}
    text = p.candle_events(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


def test_rotation_by_loops(spark, walk):
    index = walk.groupby("d")["close"].mean().reset_index(name="index_close")
    df = spark.createDataFrame(walk[["sym", "d", "close"]])
    got = p.rotation(df, spark.createDataFrame(index), n=10, ago=3, band=0.4).toPandas().sort_values(["sym", "d"])
    seen = set()
    for sym, part in walk.merge(index, on="d").sort_values("d").groupby("sym"):
        ratio = (part["close"] / part["index_close"]).to_numpy()
        phase, days = None, 0
        mine = got[got["sym"] == sym]
        for i, row in enumerate(mine.itertuples()):
            strength = ratio[i] / ratio[i - 9:i + 1].mean() * 100 if i >= 9 else None
            past = ratio[i - 3] / ratio[i - 12:i - 2].mean() * 100 if i >= 12 else None
            new = phase
            if past:
                momentum = strength / past * 100
                assert math.isclose(row.momentum, momentum, rel_tol=1e-9)
                if abs(strength - 100) >= 0.4 and abs(momentum - 100) >= 0.4:
                    new = {(True, True): "LEADING", (True, False): "WEAKENING", (False, True): "IMPROVING", (False, False): "LAGGING"}[strength > 100, momentum > 100]
            days = days + 1 if new == phase else 1
            phase = new
            seen.add(phase)
            assert (row.phase or None) == phase and (phase is None or row.phase_days == days)
    assert seen == {None, "LEADING", "WEAKENING", "IMPROVING", "LAGGING"}


def test_months_with_gaps(spark):
    ends = {"2024-01-31": 100, "2024-02-29": 110, "2024-03-28": 99, "2024-05-31": 120, "2024-06-28": 132, "2025-01-31": 60, "2025-02-28": 66, "2026-02-27": 1}
    rows = [("A", dt.date.fromisoformat(k), float(v)) for k, v in ends.items()] + [("A", dt.date(2024, 2, 5), 500.0), ("B", dt.date(2024, 1, 31), 10.0), ("B", dt.date(2024, 2, 1), 9.0)]
    df = spark.createDataFrame(rows, "sym string, d date, close double")
    got = {(r.sym, r.month.isoformat()): round(r.month_return, 9) for r in p.month_returns(df).collect()}
    assert got == {("A", "2024-02-01"): 0.1, ("A", "2024-03-01"): -0.1, ("A", "2024-06-01"): 0.1, ("A", "2025-02-01"): 0.1, ("B", "2024-02-01"): -0.1}
    out = {(r.sym, r.month_of_year): r for r in p.seasonality(df, shrink=2).collect()}
    a = out["A", 2]
    assert (a.years, a.rises) == (2, 2) and a.rise_p_lo < a.rise_p == 1 == a.rise_p_hi
    assert math.isclose(a.expected_return, (2 * 0.1 + 2 * (0.1 + 0.1 - 0.1) / 3) / 4)


def test_planted_anomalies(spark):
    rng = np.random.default_rng(8)
    rows = []
    for day in range(3):
        for i in range(400):
            value, spread = float(np.exp(rng.normal(10, 0.5))), abs(float(rng.normal(0.02, 0.005)))
            if i < 3:  # blocks at one price
                value, spread = value * 500, 0.0
            if 3 <= i < 5:
                spread = 0.9
            rows.append((f"S{i}", DAY + dt.timedelta(days=day), 100 * (1 + spread), 100.0, 100.0, value, 10, 1))
        rows.append((f"X{day}", DAY + dt.timedelta(days=day), 1.0, 1.0, 1.0, 1e15, 0, 0))
    df = spark.createDataFrame(rows, "sym string, d date, high double, low double, close double, value double, volume long, freq long")
    got = p.anomaly_proxies(df, share=0.01).toPandas()
    assert len(got) == 1200
    crossing, odd = got[got["crossing_proxy"]], got[got["anomaly_proxy"]]
    assert set(crossing["sym"]) >= {"S0", "S1", "S2"} and len(crossing) <= 12 and set(odd["sym"]) >= {"S0", "S1", "S2", "S3", "S4"}
    assert (got.groupby("d")["top_value"].sum() == 4).all() and got[got["sym"].isin(["S0", "S1", "S2"])]["top_value"].all()
    for _, day in got.groupby("d"):
        x = day["trade_value"]
        z = 0.6745 * (x - x.median()) / (x - x.median()).abs().median()
        assert np.allclose(z, day["value_z"])


def test_derived_table(spark, bars, walk):
    got = p.derived_table(bars).toPandas().sort_values(["sym", "d"])
    for sym, part in walk.sort_values("d").groupby("sym"):
        mine = got[got["sym"] == sym].reset_index(drop=True)
        close, tp = part["close"].reset_index(drop=True), ((part["high"] + part["low"] + part["close"]) / 3).reset_index(drop=True)
        for n in (5, 20, 60):
            assert np.allclose(mine[f"zscore_{n}"].astype(float), (close - close.rolling(n).mean()) / close.rolling(n).std(), equal_nan=True)
        assert np.allclose(mine["drawdown_60"].astype(float), close / close.rolling(60).max() - 1, equal_nan=True)
        cci = (tp - tp.rolling(20).mean()) / (0.015 * tp.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean()))
        assert np.allclose(mine["cci_20"].astype(float), cci, equal_nan=True)
        high = part["high"].reset_index(drop=True).rolling(20).max().shift(1)
        assert np.allclose(mine["donchian_high"].astype(float), high, equal_nan=True)
