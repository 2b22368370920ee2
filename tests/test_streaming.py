"""Streams against their batch twins; restarts."""

import datetime as dt
import math
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkbars.operators import evaluation as ev
from sparkbars.operators import windows as w
from sparkbars.operators.recurrences import with_recurrences
from sparkbars.streaming import stateful, ticks


def feed(spark, df, folder, parts, by):
    """Write a frame as ``parts`` files in order of a column and stream it, one file per batch."""
    pdf = df.toPandas().sort_values(by, ignore_index=True)
    step = -(-len(pdf) // parts)
    for i in range(parts):
        spark.createDataFrame(pdf.iloc[i * step:(i + 1) * step], df.schema).coalesce(1).write.parquet(str(folder / f"part={i:03d}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder / "part=*"))


def drain(stream, name, checkpoint, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def tick_rows(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(minutes=37 * i), f"S{i % 3}", 100 + (i * 7919) % 50 / 10, 1 + i % 5, i) for i in range(600)]
    return spark.createDataFrame(rows, "ts timestamp, sym string, price double, quantity long, tick_id long")


def test_tick_bars_stream_equals_batch(spark, tick_rows, tmp_path):
    live = ticks.bars_from_ticks(feed(spark, tick_rows, tmp_path / "in", 6, "ts"), lateness="1 day")
    got = drain(live, "tick_bars", tmp_path / "cp")
    batch = ticks.bars_from_ticks(tick_rows)
    closed = batch.filter(F.col("ts") < F.lit(got.agg(F.max("ts")).first()[0]) + F.expr("INTERVAL 1 SECOND"))
    assert got.count() > 20 and got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0


def test_late_ticks(spark, tmp_path):
    schema = "ts timestamp, sym string, price double, quantity long, tick_id long"
    d = lambda n, h=0: dt.datetime(2026, 1, n, h)
    folder = tmp_path / "in"
    for i, rows in enumerate(([(d(1), "A", 1.0, 1, 1)], [(d(20), "A", 5.0, 1, 2)], [(d(20, 1), "A", 5.0, 1, 6)], [(d(1, 1), "A", 9.0, 1, 3), (d(19), "A", 7.0, 1, 4)], [(d(28), "A", 1.0, 1, 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part={i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part=*"))
    got = {r.ts.day: r.freq for r in drain(ticks.bars_from_ticks(src, lateness="3 days"), "late_bars", tmp_path / "cp").collect()}
    assert got == {1: 1, 19: 1, 20: 2}  # the late tick of the 1st is dropped, the one of the 19th counts


def test_repeats_within_the_horizon(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1 + i // 3), "A", float(i), i * 7 % 10) for i in range(9)] + [(dt.datetime(2026, 2, 1), "A", 0.0, 0), (dt.datetime(2026, 2, 2), "A", 0.0, 0)]
    df = spark.createDataFrame(rows, "ts timestamp, sym string, close double, version int")
    got = drain(ticks.recheck(feed(spark, df, tmp_path / "in", 5, ["ts", "version"])), "rechecked", tmp_path / "cp")
    batch = ticks.settle(df.withColumn("d", F.to_date("ts")), F.lit(dt.date(2026, 1, 5))).filter("ts < '2026-01-31'").drop("d")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect())) and got.count() == 3


def shuffled_feed(spark, df, folder, seed, late_days):
    """One file per batch, rows in an order that departs from that of their dates by up to ``late_days``; at the end two
    rows of a symbol of its own move the watermark past all others."""
    pdf = df.toPandas()
    rng = np.random.default_rng(seed)
    arrival = pd.to_datetime(pdf["d"]) + pd.to_timedelta(rng.uniform(0, late_days, len(pdf)), unit="D")
    pdf = pdf.iloc[np.argsort(arrival.to_numpy(), kind="stable")]
    ends = pdf.iloc[[0, 0]].copy()
    ends["sym"] = "~END"
    ends["d"] = [max(pdf["d"]) + dt.timedelta(days=60 + i) for i in range(2)]
    cuts = [*np.array_split(np.arange(len(pdf)), 9)]
    for i, part in enumerate([*(pdf.iloc[c] for c in cuts), ends.iloc[:1], ends.iloc[1:]]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(folder / f"part={i:03d}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder / "part=*"))


@pytest.mark.parametrize("seed", [1, 2])
def test_indicators_in_any_order_of_arrival(spark, bars, tmp_path, seed):
    src = bars.select("sym", "d", "high", "low", "close", F.lit(1).cast("long").alias("version"))
    # Every tenth bar also comes in an older version with wrong prices.
    wrong = src.filter(F.dayofyear("d") % 10 == 0).withColumns({"close": F.col("close") * 3, "high": F.col("high") * 3, "version": F.lit(0).cast("long")})
    live = stateful.running_indicators(shuffled_feed(spark, src.unionByName(wrong), tmp_path / "in", seed, 10))
    rows = [r for r in drain(live, f"running{seed}", tmp_path / "cp").collect() if r.sym != "~END"]
    got = {(r.sym, r.d): r for r in rows}
    want = with_recurrences(src, [("ema", "ema", {"n": 14}), ("rsi", "rsi_ewm", {"n": 14}), ("atr", "atr_ewm", {"n": 14})]).collect()
    assert len(rows) == len(got) == len(want)
    same = lambda a, b: (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9)
    assert all(same(got[r.sym, r.d][c], r[c]) for r in want for c in ("ema", "rsi", "atr"))


def test_bars_wait_for_the_watermark_and_idle_symbols_leave(spark, tmp_path):
    schema = "sym string, d date, high double, low double, close double"
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    row = lambda s, n: (s, day(n), 2.0 + n, 1.0 + n, 1.5 + n)
    steps = [[row("A", 5), row("A", 3)], [row("A", 20)], [row("A", 21)], [row("A", 1), row("A", 4), row("A", 19)], [row("B", 60)], [row("B", 61)], [row("B", 200)], [row("B", 201)]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    live = stateful.running_indicators(src, n=1, horizon_days=10, idle_days=100)
    q = live.writeStream.format("memory").queryName("waiting").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    got = sorted((r.sym, (r.d - day(0)).days) for r in spark.table("waiting").collect())
    # 1 and 4 came after the state had moved past them (day 20 less 10), 19 before.
    assert got == [("A", 3), ("A", 5), ("A", 19), ("A", 20), ("A", 21), ("B", 60), ("B", 61)]
    assert max(states) == 2 and states[-1] == 1  # A has left, B holds two bars


def test_maturity_in_any_order_of_arrival(spark, bars, tmp_path):
    src = w.with_rn(bars).select("sym", "d", "open", "close", F.when(F.col("rn") % 3 == 0, F.col("close")).alias("entry"), "volume").withColumns(
        {"zone_low": F.col("entry") * 0.995, "zone_high": F.col("entry") * 1.02}).persist()
    live = stateful.maturing_signals(shuffled_feed(spark, src.drop("volume"), tmp_path / "in", 5, 12))
    rows = [r for r in drain(live, "maturing", tmp_path / "cp").collect() if r.sym != "~END"]
    got = {(r.sym, r.d): (r.exit_date, r.realized_return and round(r.realized_return, 9), r.outcome) for r in rows}
    preds = src.filter("entry is not null").select("sym", "d", F.col("entry").alias("entry_price"), "zone_low", "zone_high", F.lit(5).alias("horizon_days"), F.lit(0.02).alias("expected_upside"))
    want = {(r.sym, r.d): (r.decided_on, r.realized_return and round(r.realized_return, 9), r.zone_status)
            for r in ev.zone_outcomes(preds, src).filter("zone_status != 'PENDING'").collect()}
    assert got == want and len(rows) == len(want) > 200 and {v[2] for v in want.values()} == {"HIT", "MISS", "EXPIRED"}
    plain = ev.mature(preds, src).filter("outcome_status != 'PENDING'")
    entered = {k: v for k, v in want.items() if v[2] != "EXPIRED"}
    assert {(r.sym, r.d): (r.exit_date, round(r.realized_return, 9), r.outcome_status) for r in plain.collect() if (r.sym, r.d) in entered} == entered
    src.unpersist()


@pytest.mark.parametrize("cut", [1, 2, 7, 40])
def test_advancing_does_not_depend_on_the_cuts(walk, cut):
    one = walk[walk["sym"] == "AAAA"].reset_index(drop=True)
    advance, state, parts = stateful.advance_indicators(14), (0, 0.0, 0.0, 0.0, 0.0, 0.0), []
    for start in range(0, len(one), cut):
        rows, state = advance(("AAAA",), state, one.iloc[start:start + cut].reset_index(drop=True))
        parts.append(rows)
    whole, last = advance(("AAAA",), (0, 0.0, 0.0, 0.0, 0.0, 0.0), one)
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole)
    assert np.allclose(state, last)


def test_sessions_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    start = dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(minutes=int(m)), f"S{k % 2}", float(k % 7), 1, k) for k, m in enumerate(np.sort(rng.integers(0, 4000, 150)))]
    df = spark.createDataFrame(rows, "ts timestamp, sym string, price double, quantity long, tick_id long")
    ends = spark.createDataFrame([(start + dt.timedelta(days=30 + i), "~", 1.0, 1, 9000 + i) for i in range(2)], df.schema)
    batch = ticks.sessions(df, "25 minutes")
    assert 20 < batch.count() < 150
    folder = tmp_path / "in"
    parts = df.toPandas().sample(frac=1, random_state=3)  # ticks of all sessions in every batch, so sessions get bridged
    for i, part in enumerate([*(parts.iloc[c] for c in np.array_split(np.arange(len(parts)), 4))]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(folder / f"part={i}"))
    for i in range(2):
        ends.filter(F.col("tick_id") == 9000 + i).coalesce(1).write.parquet(str(folder / f"part={4 + i}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part=*"))
    got = drain(ticks.sessions(src, "25 minutes", "10 days"), "sessions", tmp_path / "cp").filter("sym <> '~'")
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0
    # One definition: gaps of more than 25 minutes start a session.
    line = df.toPandas().sort_values(["sym", "ts", "tick_id"])
    new = line.groupby("sym")["ts"].diff().gt(pd.Timedelta(minutes=25)) | ~line["sym"].duplicated()
    want = line.groupby(new.cumsum()).agg(sym=("sym", "first"), start=("ts", "min"), freq=("ts", "size"))
    assert sorted(map(tuple, batch.select("sym", "start", "freq").collect())) == sorted(map(tuple, want.to_numpy()))


def test_daily_sink_survives_a_restart(spark, tmp_path):
    schema = "d string, sym string, v int"
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def land(i, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part={i}"))

    def run(checkpoint):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part=*"))
        q = ticks.write_days(src, out, str(checkpoint)).start()
        q.processAllAvailable()
        q.stop()

    land(0, [("2026-01-01", "A", 1), ("2026-01-02", "A", 2)])
    run(tmp_path / "cp")
    land(1, [("2026-01-02", "B", 3)])
    run(tmp_path / "cp")
    read = lambda: sorted((str(r.d), r.sym, r.v) for r in ticks.read_days(spark, out).collect())
    want = [("2026-01-01", "A", 1), ("2026-01-02", "A", 2), ("2026-01-02", "B", 3)]
    assert read() == want
    run(tmp_path / "cp")  # nothing new: nothing changes
    assert read() == want
    run(tmp_path / "cp2")  # all batches again: the same folders are written again
    assert read() == want
    land(2, [("2026-01-02", "A", 9), ("2026-01-03", "C", 4)])
    run(tmp_path / "cp")  # a correction
    assert read() == [want[0], ("2026-01-02", "A", 9), want[2], ("2026-01-03", "C", 4)]
    one = str(tmp_path / "one")  # all rows in one batch give the same table
    q = ticks.write_days(spark.readStream.schema(schema).parquet(str(folder / "part=*")), one, str(tmp_path / "cp3")).start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r.d), r.sym) for r in ticks.read_days(spark, one).collect()} == {(d, s) for d, s, _ in read()}
    shutil.rmtree(tmp_path / "cp2", ignore_errors=True)
