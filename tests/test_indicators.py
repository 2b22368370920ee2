"""Window and recursive operators against plain loops written from their definitions."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkbars.operators import windows as w
from sparkbars.operators.recurrences import ema_latest, with_recurrences
from sparkbars.operators.universe import universe_series
from sparkbars.plans.base import present, rounded


def by_symbol(df, column):
    pdf = df.select("sym", "d", column).toPandas().sort_values(["sym", "d"])
    return {s: g[column].to_numpy(float) for s, g in pdf.groupby("sym")}


def series(walk, column="close"):
    return {s: g.sort_values("d")[column].to_numpy(float) for s, g in walk.groupby("sym")}


def check(got, want, tolerance=1e-8):
    assert got.keys() == want.keys()
    for s in got:
        np.testing.assert_allclose(got[s], want[s], rtol=tolerance, atol=tolerance, equal_nan=True)


def loop_ema_seeded(x, n):
    out, k = [math.nan] * len(x), 2 / (n + 1)
    e = None
    for i, v in enumerate(x):
        if i == n - 1:
            e = sum(x[:n]) / n
        elif i >= n:
            e = v * k + e * (1 - k)
        if e is not None:
            out[i] = e
    return np.array(out)


def loop_rsi_wilder(x, n):
    out = [math.nan] * len(x)
    up = [max(b - a, 0) for a, b in zip(x, x[1:])]
    dn = [max(a - b, 0) for a, b in zip(x, x[1:])]
    g, l = sum(up[:n]) / n, sum(dn[:n]) / n
    for i in range(n, len(x)):
        if i > n:
            g, l = (g * (n - 1) + up[i - 1]) / n, (l * (n - 1) + dn[i - 1]) / n
        out[i] = 100.0 if l == 0 else 100 - 100 / (1 + g / l)
    return np.array(out)


def true_ranges(h, l, c):
    return [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, len(c))]


def loop_atr_wilder(h, l, c, n):
    tr, out = true_ranges(h, l, c), [math.nan] * len(c)
    a = sum(tr[:n]) / n
    for i in range(n, len(c)):
        a = a if i == n else (a * (n - 1) + tr[i - 1]) / n
        out[i] = a
    return np.array(out)


def loop_adx(h, l, c, n):
    tr = true_ranges(h, l, c)
    up = [h[i] - h[i - 1] for i in range(1, len(c))]
    dn = [l[i - 1] - l[i] for i in range(1, len(c))]
    plus = [max(u, 0) if u > d else 0 for u, d in zip(up, dn)]
    minus = [max(d, 0) if d > u else 0 for u, d in zip(up, dn)]
    a, p, m = sum(tr[:n]), sum(plus[:n]), sum(minus[:n])
    dx = []
    for i in range(n - 1, len(tr)):
        if i >= n:
            a, p, m = a - a / n + tr[i], p - p / n + plus[i], m - m / n + minus[i]
        pd_, md = (100 * p / a, 100 * m / a) if a else (0, 0)
        dx.append(abs(pd_ - md) / (pd_ + md) * 100 if pd_ + md > 0 else 0)
    out = [math.nan] * len(c)
    v = sum(dx[:n]) / n
    for i in range(n, len(dx)):
        v = (v * (n - 1) + dx[i]) / n
        out[n + i] = v
    return np.array(out)


def test_recurrences_match_loops(bars, walk):
    df = with_recurrences(bars.select("sym", "d", "high", "low", "close"), [
        ("e9", "ema_sma", {"n": 9}), ("r", "rsi_wilder", {"n": 14}), ("a", "atr_wilder", {"n": 14}), ("x", "adx", {"n": 14}),
        ("e", "ema", {"n": 20}), ("m", "macd", {})]).persist()
    c, h, l = series(walk), series(walk, "high"), series(walk, "low")
    check(by_symbol(df, "e9"), {s: loop_ema_seeded(c[s], 9) for s in c})
    check(by_symbol(df, "r"), {s: loop_rsi_wilder(c[s], 14) for s in c})
    check(by_symbol(df, "a"), {s: loop_atr_wilder(h[s], l[s], c[s], 14) for s in c})
    check(by_symbol(df, "x"), {s: loop_adx(h[s], l[s], c[s], 14) for s in c})
    line = {s: loop_ema_seeded(c[s], 12) - loop_ema_seeded(c[s], 26) for s in c}
    check(by_symbol(df, "m_line"), line)
    sig = {s: np.concatenate([np.full(25, np.nan), loop_ema_seeded(line[s][25:], 9)]) for s in c}
    check(by_symbol(df, "m_signal"), sig)
    df.unpersist()


def test_latest_ema_without_python(bars, walk):
    arrays = bars.groupBy("sym").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "close"))), lambda x: x["close"]).alias("xs"))
    got = {r.sym: r.e for r in arrays.select("sym", ema_latest(F.col("xs"), 21).alias("e")).collect()}
    for s, x in series(walk).items():
        assert math.isclose(got[s], loop_ema_seeded(x, 21)[-1], rel_tol=1e-12)


def test_wide_windows_equal_direct_ones(bars):
    df = w.with_extremes(w.with_rn(bars), {"hi": ("max", "close", 252), "lo": ("min", "close", 55)})
    df = w.with_means(df, {"m200": ("close", 200), "m50": ("close", 50)})
    df = df.withColumns({"hi2": F.max("close").over(w.trail(252)), "lo2": F.min("close").over(w.trail(55)), "m200b": w.sma("close", 200), "m50b": w.sma("close", 50)})
    bad = df.filter("hi != hi2 or lo != lo2 or abs(m200 - m200b) > 1e-8 or abs(m50 - m50b) > 1e-8 or (m200 is null) != (m200b is null)")
    assert bad.count() == 0


def test_back_adjustment_follows_the_reference_chain(spark):
    rows = [("A", f"2024-01-0{i}", c, p) for i, c, p in ((2, 100.0, None), (3, 110.0, 100.0), (4, 52.0, 55.0), (5, 53.0, 52.0), (8, 50.0, 0.0))]
    df = spark.createDataFrame(rows, "sym string, d string, close double, prev double").selectExpr("sym", "to_date(d) d", "close", "prev", "close high", "close low")
    got = [r.adj for r in w.back_adjust(df).orderBy("d").collect()]
    # From the newest close backwards, each earlier close is divided by close / reference.
    closes, refs = [100.0, 110.0, 52.0, 53.0, 50.0], [None, 100.0, 55.0, 52.0, 53.0]
    chain = [closes[-1]]
    for c, r in zip(reversed(closes[1:]), reversed(refs[1:])):
        chain.append(chain[-1] / (c / r))
    assert np.allclose(got, list(reversed(chain)))
    assert w.gap_events(df).count() == 1


def test_split_detection(spark):
    def rows(sym, items):
        return [(sym, f"2026-01-0{i + 1}", float(c), 1000, s) for i, (c, s) in enumerate(items)]
    data = rows("SPLT", [(1000, 1_000_000), (1000, 1_000_000), (200, 5_000_000)]) + rows("RASE", [(500, 2_000_000), (505, 2_000_000), (505, 2_200_000)]) \
        + rows("STBL", [(100, 10), (101, 10), (102, 10)])
    df = spark.createDataFrame(data, "sym string, d string, close double, volume long, shares long").withColumn("d", F.to_date("d"))
    got = {r.sym: (r.action, r.confidence, r.share_ratio) for r in w.corporate_actions(df).collect()}
    assert got == {"SPLT": ("SPLIT_LIKE", "HIGH", 5.0), "RASE": ("CAPITAL_CHANGE", "MEDIUM", 1.1)}


def test_streaks_count_whole_runs(spark):
    closes = [1, 2, 3, 2, 1, 1, 2]
    df = spark.createDataFrame([("A", i, float(c)) for i, c in enumerate(closes)], "sym string, d int, close double")
    got = [(r.up_streak, r.dn_streak) for r in w.streak(df).orderBy("d").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (0, 1), (0, 2), (0, 0), (1, 0)]


def test_row_order_does_not_matter(bars):
    a = w.with_sma(w.back_adjust(bars)).select("sym", "d", "adj", "sma20")
    b = w.with_sma(w.back_adjust(bars.repartition(7).orderBy(F.rand(3)))).select("sym", "d", "adj", "sma20")
    assert a.exceptAll(b).count() == 0


def test_zero_prices_do_not_fail(spark):
    df = spark.createDataFrame([("A", i, 0.0, 5) for i in range(30)], "sym string, d int, close double, volume int")
    df = w.with_pct_change(w.with_rn(df)).withColumns({"roc": w.roc(10), "c": w.vol_price_corr(5)})
    assert df.filter("pc is not null or roc is not null or c is not null").count() == 0


def test_downsample_keeps_ends(bars):
    got = w.downsample(bars.select("sym", "d", "close"), 50).groupBy("sym").agg(F.count("*").alias("n"), F.min("rn").alias("a"), F.max("rn").alias("b")).collect()
    sizes = {"AAAA": 320, "BBBB": 280, "CCCC": 240}
    assert {(r.sym, r.n, r.a, r.b) for r in got} == {(s, 50, 1, n) for s, n in sizes.items()}


def test_activity_on_a_bound_is_not_moved_by_the_shares(spark):
    """20 volumes of 25 in the mean and then 30: exactly 1.2, whatever the listed shares."""
    from sparkbars.operators import snapshot
    rows = [(f"S{k}", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i, v, 1.0, 1, 1_000_000 + 1000 * k)
            for k in range(40) for i, v in enumerate([20, 30, 24, 26, 1, 49, 7, 43, 25, 25] * 2 + [30])]
    df = spark.createDataFrame(rows, "sym string, d date, close double, volume long, value double, freq long, shares long")
    df = df.selectExpr("*", "close AS high", "close AS low", "close AS open", "CAST(NULL AS DOUBLE) AS prev", "0.0 AS fbuy", "0.0 AS fsell")
    for out in (snapshot.technicals(df), w.activity_ratios(df)):
        assert {r["confirmation_ratio"] for r in out.filter("d = DATE'2024-01-21'").collect()} == {1.2}
    moved = df.withColumn("shares", F.when(F.col("d") < "2024-01-11", F.col("shares") / 2).otherwise(F.col("shares")))
    got = {r["sym"]: r["turnover_ratio"] for r in w.activity_ratios(moved).filter("d = DATE'2024-01-21'").collect()}
    assert max(abs(x - 0.8) for x in got.values()) < 1e-12


def test_recurrences_leave_other_columns_alone(spark):
    """Only three prices are looked at; whatever else a row holds passes as it is, NaN and NULL apart."""
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i, x, i if i % 2 else None) for i, x in enumerate([float("nan"), None, 1.0, 2.0])]
    df = spark.createDataFrame(rows[::-1], "sym string, d date, close double, x double, n int").selectExpr("*", "close AS high", "close AS low", "array(n) AS ns")
    out = with_recurrences(df, [("ema2", "ema", {"n": 2})]).orderBy("d").collect()
    assert math.isnan(out[0].x) and [r.x for r in out[1:]] == [None, 1.0, 2.0] and [r.n for r in out] == [None, 1, None, 3]
    assert [r.ns for r in out] == [[None], [1], [None], [3]] and out[0].ema2 is None and out[1].ema2 > 10


def test_relative_activity_in_two_levels(bars):
    """The same means as frames of 60 rows, gaps included, without reading 60 rows for every row."""
    gaps = bars.withColumns({"volume": F.when(F.dayofmonth("d") % 5 != 0, F.col("volume")), "value": F.when(F.month("d") != 6, F.col("value"))})
    two = w.with_relative_activity(gaps)
    plain = w.with_rn(gaps).withColumns(w.relative_activity())
    names = list(w.relative_activity())
    a, b = (x.select("sym", "d", *names).orderBy("sym", "d").toPandas() for x in (two, plain))
    assert list(a.columns) == list(b.columns) and set(two.columns) == set(plain.columns)
    for n in names:
        np.testing.assert_allclose(a[n].to_numpy(float), b[n].to_numpy(float), rtol=1e-12, equal_nan=True, err_msg=n)
    assert "-59" not in two._jdf.queryExecution().optimizedPlan().toString()


def test_rounding_makes_no_decimals(spark):
    """Printed numbers are scaled and rounded: no decimal of every value, no negative zero, odd values stay what they are."""
    values = [0.0, -0.0, -4e-8, 1.2345674, -1.2345678, 123456.7890123, 1e12, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [repr(r.x) for r in df.select(rounded(F.col("x"), 6).alias("x")).collect()] == [
        "0.0", "0.0", "0.0", "1.234567", "-1.234568", "123456.789012", "1000000000000.0", "inf", "nan", "None"]
    plan = present(df.withColumn("y", F.col("x")), "x:6 y:2", True)._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan and "round(" not in plan


def test_drawdown_from_blocks(spark):
    """Every width, short series and gaps included, as running over the rows one by one."""
    rng = random.Random(5)
    xs = [None if rng.random() < 0.03 else 0.0 if rng.random() < 0.02 else rng.uniform(1, 100) for _ in range(150)]
    start = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("A", start + dt.timedelta(i), x) for i, x in enumerate(xs)], "sym string, d date, adj double")
    for n in (2, 7, 60):
        got = [r.mdd for r in w.with_max_drawdown(df, "mdd", n).orderBy("d").collect()]
        for i, value in enumerate(got):
            peak = dd = 0.0
            for x in (x for x in xs[max(0, i - n + 1):i + 1] if x is not None):
                peak = max(peak, x)
                dd = min(dd, x / peak - 1) if peak > 0 else dd
            assert value == (None if i == 0 else dd * 100)
    plan = w.with_max_drawdown(df, "mdd", 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_counts_in_calendar_days(spark):
    """Flags of the last days by running totals: no frame that moves along with the row."""
    rng = random.Random(6)
    days = sorted(rng.sample(range(400), 150))
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(k), rng.choice([0, 0, 1, None])) for k in days]
    df = spark.createDataFrame(rows, "sym string, d date, hit int").withColumn("n", w.count_in_days("hit", 30))
    for (_, d, _), r in zip(rows, df.orderBy("d").collect()):
        assert r.n == sum(h or 0 for _, e, h in rows if 0 <= (d - e).days <= 30)
    bars = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1)], "sym string, d date, close double, prev double, value double, freq double, volume long")
    plan = universe_series(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "-120" not in plan


def test_wide_volatility_from_blocks(bars):
    """Blocks give the deviation of the whole frame, also where prices are missing, and read no frame of 60 rows."""
    gaps = bars.withColumn("close", F.when(F.dayofmonth("d") % 9 != 0, F.col("close")).otherwise(F.when(F.col("sym") == "AAAA", F.lit(0.0))))
    gaps = gaps.unionByName(bars.withColumns({"sym": F.lit("NONE"), "close": F.lit(None).cast("double")}).limit(200))
    df = w.with_pct_change(w.with_rn(gaps))
    got = w.with_hvols(df, 20, 3)
    for name, wide in (("hvol20", 20), ("hvol60", 60)):
        check(by_symbol(got, name), by_symbol(df.withColumn(name, w.hvol(wide)), name))
    assert "-59" not in got._jdf.queryExecution().analyzed().toString()
