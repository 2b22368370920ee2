"""Rule tables on hand-made fixtures: universe, decisions, ensembles, schedules, texts, dates."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkbars.functions import dates, numbers, prices, text
from sparkbars.operators import decisions as dc
from sparkbars.operators import labels as lb
from sparkbars.operators import models as ml
from sparkbars.operators import universe as un


def sessions(n):
    """Weekdays from the first Monday of 2025."""
    out, d = [], dt.date(2025, 1, 6)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def symbol(name, n=70, price=500.0, value=2e9, freq=400, jumps=(), by=1.0, idle=(), skip=0):
    """Bars of one symbol: a flat price with ``jumps`` at some sessions, no volume at ``idle`` ones, none in the last ``skip``."""
    rows, last = [], None
    for i, d in enumerate(sessions(n)[:n - skip]):
        close = (last or price) * (by if i in jumps else 1.0)
        rows.append((name, d, close, last, 0 if i in idle else 1000, value, freq))
        last = close
    return rows


LIMITS = {"min_history": 60, "min_value": 1e9, "min_freq": 300, "min_price": 100}
#: One pair per rule: just inside it and just outside.
CASES = {
    "hist_in": ("INSUFFICIENT_HISTORY", {"n": 70, "skip": 11}), "hist_out": ("ELIGIBLE", {"n": 70, "skip": 10 - 9}),
    "penny_in": ("PENNY_STOCK", {"price": 99.9}), "penny_out": ("ELIGIBLE", {"price": 100.0}),
    "small_in": ("LOW_LIQUIDITY", {"value": 0.99e9}), "small_out": ("ELIGIBLE", {"value": 1e9}),
    "rare_in": ("LOW_LIQUIDITY", {"freq": 299}), "rare_out": ("ELIGIBLE", {"freq": 300}),
    "pump_in": ("GORENGAN_SUSPECTED", {"jumps": (30, 35, 40, 45), "by": 1.21}), "pump_out": ("ELIGIBLE", {"jumps": (30, 35, 40), "by": 1.21}),
    "event_in": ("CORPORATE_ACTION_WARNING", {"jumps": (50,), "by": 1.26}), "event_out": ("ELIGIBLE", {"jumps": (50,), "by": 1.24}),
    "fall_in": ("CORPORATE_ACTION_WARNING", {"jumps": (50,), "by": 0.74}),
    "idle_in": ("SUSPENDED", {"idle": range(30, 70)}), "board_in": ("GORENGAN_SUSPECTED", {}), "board_out": ("ELIGIBLE", {}),
}


@pytest.fixture(scope="module")
def fixture_bars(spark):
    rows = [r for name, (_, shape) in CASES.items() for r in symbol(name, **shape)]
    return spark.createDataFrame(rows, "sym string, d date, close double, prev double, volume long, value double, freq long")


@pytest.fixture(scope="module")
def fixture_master(spark):
    return spark.createDataFrame([(s, "Watchlist" if s == "board_in" else "Main") for s in CASES], "sym string, board string")


def test_universe_statuses(fixture_bars, fixture_master):
    asof = F.lit(sessions(70)[-1])
    got = {r.sym: r.status for r in un.universe(fixture_bars, asof, fixture_master, **LIMITS).collect()}
    assert got == {name: status for name, (status, _) in CASES.items()}
    assert set(got.values()) == {"INSUFFICIENT_HISTORY", "PENNY_STOCK", "SUSPENDED", "GORENGAN_SUSPECTED", "LOW_LIQUIDITY", "CORPORATE_ACTION_WARNING", "ELIGIBLE"}


def test_universe_series_equals_single_dates(spark, fixture_bars, fixture_master):
    # Unpriced rows: the last 20 priced rows count, with NULLs left out.
    odd = [(n, d, 0.0 if i % 2 else c, p, v, 10.0 * i if i % 4 else None, f) for i, (n, d, c, p, v, _, f) in enumerate(symbol("holes"))]
    bars = fixture_bars.union(spark.createDataFrame(odd, fixture_bars.schema))
    every = un.universe_series(bars, fixture_master, **LIMITS)
    for k in (62, 70):
        day = F.lit(sessions(k)[-1])
        columns = ("status", "close_20", "value_20", "freq_20")
        a = {r.sym: tuple(r[c] for c in columns) for r in every.filter(F.col("d") == day).collect()}
        b = {r.sym: tuple(r[c] for c in columns) for r in un.universe(bars, day, fixture_master, **LIMITS).collect()}
        assert "holes" in a and all(b[s] == x for s, x in a.items())


def test_universe_does_not_look_ahead(fixture_bars):
    cut = F.lit(sessions(55)[-1])
    whole = un.universe_series(fixture_bars, **LIMITS).filter(F.col("d") <= cut)
    past = un.universe_series(fixture_bars.filter(F.col("d") <= cut), **LIMITS)
    assert whole.exceptAll(past).count() == 0


def test_costs_and_decisions(spark):
    cols = "id int, p double, entry_price double, target_price double, stop_price double, models int, models_expected int, holdout_status string, feature_coverage double, has_action_warning boolean"
    base = (0.7, 100.0, 110.0, 98.0, 6, 6, "VERIFIED_ABOVE_90", 1.0, False)

    def row(i, **kw):
        names = ["p", "entry_price", "target_price", "stop_price", "models", "models_expected", "holdout_status", "feature_coverage", "has_action_warning"]
        values = dict(zip(names, base)) | kw
        return (i, *[values[n] for n in names])

    rows = [row(0), row(1, models=0), row(2, feature_coverage=0.2), row(3, has_action_warning=True), row(4, target_price=102.0), row(5, p=0.45, target_price=130.0),
            row(6, holdout_status=None), row(7, models=2), row(8, p=0.9, holdout_status="NOT_VERIFIED")]
    got = {r.id: r for r in dc.decide(dc.with_economics(spark.createDataFrame(rows, cols))).collect()}
    assert [got[i].decision_status for i in range(9)] == ["QUALIFIED", "MODEL_UNAVAILABLE", "DATA_INVALID", "NO_TRADE", "NO_TRADE", "ABSTAIN", "WATCHLIST", "WATCHLIST", "WATCHLIST"]
    assert got[0].confidence_tier == "SANGAT_KUAT" and got[8].confidence_tier == "CUKUP"
    assert math.isclose(got[4].net_reward, 0.02 - ml.ROUND_TRIP) and math.isclose(got[4].net_risk, 0.02 + ml.ROUND_TRIP) and got[4].net_risk_reward < 1


def test_probability_follows_its_symbol(spark):
    feats = spark.createDataFrame([("AAAA", "2026-01-06", 1000.0, 1.0), ("BBBB", "2026-01-06", 2000.0, None), ("CCCC", "2026-01-06", 500.0, 2.0)], "sym string, d string, close double, f1 double")
    probs = spark.createDataFrame([("CCCC", "2026-01-06", 0.9, 1, False), ("AAAA", "2026-01-06", 0.1, 1, False)], "sym string, d string, p double, models int, has_action_warning boolean")
    a = {r.sym: r.p for r in dc.assemble_predictions(feats, probs, ["f1"], 0.6, 1, None).collect()}
    b = {r.sym: r.p for r in dc.assemble_predictions(feats.orderBy(F.desc("sym")), probs.repartition(3), ["f1"], 0.6, 1, None).collect()}
    assert a == b == {"AAAA": 0.1, "CCCC": 0.9}


def test_failing_model_is_left_out(spark):
    rows = [("X", 1, "A", 0.6, 0.4), ("X", 1, "B", None, 0.5), ("Y", 1, "A", 0.2, 0.4), ("Y", 1, "B", 0.8, 0.4)]
    got = {r.sym: r for r in ml.ensemble(spark.createDataFrame(rows, "sym string, d int, model_name string, p double, weight double")).collect()}
    assert math.isclose(got["X"].probability, 0.6) and "B" not in got["X"].breakdown
    assert math.isclose(got["Y"].probability, (0.2 ** 3 + 0.8 ** 3) / (0.2 ** 2 + 0.8 ** 2))


@pytest.mark.parametrize("schedule, age, due", [("weekly", 8, True), ("weekly", 2, False), ("monthly", 20, False), ("manual", 90, False), ("daily", 1, True)])
def test_retrain_schedule(spark, schedule, age, due):
    now = dt.datetime(2026, 8, 1, 12)
    runs = spark.createDataFrame([(now - dt.timedelta(days=age),), (now - dt.timedelta(days=age + 50),)], "created_at timestamp")
    assert ml.retrain_due(runs, schedule, F.lit(now)).first().is_due is due


def test_retrain_needs_history_and_outcomes(spark):
    none = spark.createDataFrame([], "created_at timestamp")
    assert ml.retrain_due(none, "weekly", F.lit(dt.datetime(2026, 8, 1))).first().is_due is False
    runs = spark.createDataFrame([(dt.datetime(2026, 1, 1),)], "created_at timestamp")
    assert ml.retrain_due(runs, "weekly", F.lit(dt.datetime(2026, 8, 1)), new_outcomes=0).first().is_due is False


def test_ordered_rules_explain_texts(spark):
    rules = ((r"^gain of (\d+)$", "It gained $1."), (r"^gain", "It gained."), (r"loss", "It lost."))
    df = spark.createDataFrame([("gain of 12",), ("gains",), ("a loss",), ("flat",), (None,)], "t string")
    assert [r.e for r in df.select(text.explain("t", rules).alias("e")).collect()] == ["It gained 12.", "It gained.", "It lost.", "flat", None]


def test_reasons_and_flags_have_both_wordings(spark):
    cols = ["return_5d", "return_20d", "rsi14", "ma_aligned_bull", "close_vs_high_20d", "close_vs_high_60d", "rel_volume_5d", "bb_squeeze", "bb_position", "macd_bullish", "foreign_net_5d",
            "efficiency_ratio_20d", "close_location", "avg_value_20d", "hvol20", "close_vs_low_120d", "zero_vol_pct_20d"]
    high = spark.createDataFrame([tuple([0.0612, 0.07, 75.0, 1.0, 0.0, 0.0, 2.04, 1.0, 0.9, 1.0, 0.02, 0.8, 0.9, 1e8, 0.5, 0.01, 0.3])], [*cols]).withColumns(
        {"market_regime": F.lit("BEAR_TREND"), "has_action_warning": F.lit(True)})
    row = high.select(dc.reason_codes(20).alias("c"), dc.reasons(20).alias("r"), dc.risks().alias("k"), dc.reasons().alias("six"),
                      dc.wording(F.concat(dc.reason_codes(20), dc.risk_codes()), plain=True).alias("e")).first()
    assert len(row.r) == len(row.c) == 11 and len(row.six) == 6 and len(row.k) == 7 and len(row.e) == 18
    assert row.r[0] == "Strong 5-day momentum (+6.1%)" and row.e[0].startswith("Five sessions have added 6.1%")
    assert not any("$1" in x for x in row.r + row.k + row.e)
    assert all(("$1" in a) == ("$1" in b) for a, b in dc.FINDINGS.values())


def test_numbers(spark):
    cases = [("1.234.567", 1234567.0), ("1.234", 1234.0), ("12.34", 12.34), ("1.234,5", 1234.5), ("7,25", 7.25), ("-", None), ("", None), ("nan", None), (" 12 345 ", 12345.0)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "s string").select("s", numbers.parse_number("s").alias("x"))
    assert [r.x for r in df.collect()] == [b for _, b in cases]
    loose = [("Rp 1.234.567", 1234567), ("1,234.6 lot", 1235), ("2.500", 2500), ("2,5", 2), ("abc", 0), (None, 0), ("1.234,75", 1235), ("-300", -300), ("3.5", 4)]
    df = spark.createDataFrame([(a,) for a, _ in loose], "s string").select(numbers.parse_int_loose("s").alias("x"))
    assert [r.x for r in df.collect()] == [b for _, b in loose]


def test_dates_and_ticks(spark):
    df = spark.createDataFrame([(dt.date(2026, 7, 27),), (dt.date(2026, 7, 31),), (dt.date(2026, 8, 1),)], "d date")
    got = [r.x for r in df.select(dates.add_weekdays("d", 5).alias("x")).collect()]
    assert got == [dt.date(2026, 8, 3), dt.date(2026, 8, 7), dt.date(2026, 8, 7)]
    ticks = spark.createDataFrame([(150.5,), (301.0,), (1002.5,), (3012.5,), (7125.0,)], "p double").select(prices.tick_round("p").alias("t"))
    assert [r.t for r in ticks.collect()] == [150.0, 300.0, 1000.0, 3000.0, 7100.0]
    parsed = spark.createDataFrame([("2026-07-27",), ("27/7/2026",), ("27 Jul 2026",), ("soon",)], "s string").select(dates.parse_date("s").alias("d"))
    assert [r.d for r in parsed.collect()] == [dt.date(2026, 7, 27)] * 3 + [None]


def test_holder_classes(spark):
    cases = {"ID": "Individual", "Corporate Ltd": "Corporate", "MF": "Fund / Asset Manager", "Pension Fund": "Pension Fund", "PF": "Pension Fund", "IB": "Financial Institution",
             "Securities house": "Securities / Investment", "insurance": "Insurance", "FD": "Foundation", "": "Unclassified", "Cooperative": "Cooperative"}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", text.holder_class("c").alias("h"))
    assert {r.c: r.h for r in df.collect()} == cases


def test_select_only(spark):
    assert text.run_select(spark, "SELECT 1 AS x").count() == 1
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", ""):
        with pytest.raises(ValueError):
            text.run_select(spark, bad)


def test_leakage_report(spark):
    df = spark.createDataFrame([(1, 1), (3, 2)], "feature_as_of int, d int")
    found = lb.leakage(df, ["rsi14", "trade_return"])
    assert len(found) == 2 and not lb.leakage(df.filter("d > 2"), ["rsi14"])
    assert lb.purge_is_safe(6, 5) and not lb.purge_is_safe(5, 5)
