"""Landing files, gates and stores in temporary folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkbars.sources import landing, quality, store
from sparkbars.sources.snapshots import Snapshots


def test_csv_with_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Stock_Code,TANGGAL,Penutupan,Volume,Nilai\n bbca ,27/7/2026,9.150,1.234.567,\"1.000,5\"\n,2026-07-27,1,1,1\nTLKM,bad,1,1,1\n")
    r = landing.read_bars(spark, str(tmp_path)).collect()
    assert [(x.sym, x.d, x.close, x.volume, x.value, x.open) for x in r] == [("BBCA", dt.date(2026, 7, 27), 9150.0, 1234567, 1000.5, None)]


def test_mandatory_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("close\n1\n")
    try:
        landing.read_bars(spark, str(tmp_path))
    except ValueError as e:
        assert "sym" in str(e)
    else:
        raise AssertionError("no error")


def snapshot_text(records, total=None):
    return json.dumps({"recordsTotal": len(records) if total is None else total, "data": records})


def test_json_snapshots(spark):
    day = dt.date(2026, 7, 27)
    records = [{"Date": "2026-07-27T00:00:00", "StockCode": " bbca ", "Close": 9150, "Volume": "120", "Previous": "", "ForeignBuy": 5.0},
               {"Date": "2026-07-24T00:00:00", "StockCode": "OLD"}, {"Date": "2026-07-27T00:00:00", "StockCode": ""}]
    raw = spark.createDataFrame([(day, snapshot_text(records))], "day date, payload string")
    got = landing.parse_snapshot(raw).collect()
    assert [(r.sym, r.d, r.close, r.volume, r.prev, r.fbuy, r.declared) for r in got] == [("BBCA", day, 9150.0, 120, None, 5.0, 3)]
    index = spark.createDataFrame([(day, snapshot_text([{"Date": "2026-07-27", "IndexCode": "composite", "Close": "7000.5", "NumberOfStock": 900}]))], "day date, payload string")
    got = landing.parse_index_snapshot(index).first()
    assert (got.index_code, got.close, got.stocks) == ("COMPOSITE", 7000.5, 900)


def test_tolerant_payloads(spark):
    deep = '{"code": "DEEP"}'
    for k in range(40):
        deep = f'{{"k{k}": {deep if k else "[" + deep + "]"}}}'
    texts = ['[{"Code": "AB"}]', '{"data": [{"CODE": "CD", "name": ""}]}', '{"result": {"items": [{"kode": "EF"}, {"kode": "GH"}]}}', '{"x": 1}', '{"payload": {"rows": [{"code": "IJ"}]}}',
             '{"data": {"a": 1}, "result": {"items": [{"code": "KL"}]}}', '{"other": [{"code": "no"}], "data": [{"code": "MN"}, 7]}', '{"data": [], "other": [{"code": "no"}]}', "no json", None, "[]", deep]
    raw = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = landing.extract_records(raw).select(landing.pick(F.col("record"), ("kode", "code")).alias("c")).collect()
    assert sorted(r.c for r in got) == ["AB", "CD", "DEEP", "EF", "GH", "IJ", "KL", "MN"]


def test_file_ledger(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "c.txt").write_text("one")
    first = landing.ingest_files(spark, str(tmp_path), None)
    assert sorted(r.payload for r in first.collect()) == ["one", "two"]
    ledger = spark.createDataFrame([(r.sha256,) for r in first.filter("payload = 'one'").collect()], "sha256 string")
    assert [r.payload for r in landing.ingest_files(spark, str(tmp_path), ledger).collect()] == ["two"]


def test_payload_changes(spark):
    df = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b")], "source string, fetched_at int, payload string")
    assert [r.status for r in landing.changed_payloads(df).orderBy("fetched_at").collect()] == ["changed", "no_change", "changed"]


def test_gates(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "A"), (3, "A")], "d int, sym string")
    declared = spark.createDataFrame([(1, 2), (2, 2), (3, 5)], "d int, declared long")
    good, bad = quality.validate_snapshot(df, declared)
    assert {r.d for r in good.collect()} == {1} and {r.d: r.reason for r in bad.collect()} == {2: "duplicate symbols", 3: "incomplete"}
    rows = spark.createDataFrame([(1, "A", 5), (1, "A", 5), (2, "A", 5), (2, "A", 6)], "d int, k string, v int")
    kept, rejected = quality.dedupe_or_reject(rows, ["d", "k"])
    assert kept.count() == 1 and [r.d for r in rejected.collect()] == [2]


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, -1.0, "a"), (2, 3.0, "z"), (3, None, None)], "id int, x double, k string")
    known = spark.createDataFrame([("a",)], "k string")
    good, bad = quality.expect(df, {"x >= 0": F.col("x") >= 0}, unique=["id"], references={"k": (known, "k")})
    assert sorted(r.id for r in good.collect()) == [1, 3] and good.columns == df.columns
    assert sorted((r.id, tuple(r.reasons)) for r in bad.collect()) == [(2, ("unique", "unknown k")), (2, ("x >= 0", "unique"))]


def test_pending_and_log(spark):
    d = lambda x: dt.date(2026, 7, x)
    log = spark.createDataFrame([(d(20), "success", 1, 9), (d(21), "failed", 2, 0), (d(22), "no_data", 1, 0), (d(29), "success", 1, 9)], "d date, status string, attempts int, row_count int")
    got = [r.d.day for r in quality.pending_dates(log, F.lit("2026-07-20").cast("date"), F.lit("2026-07-31").cast("date"), 3).orderBy("d").collect()]
    assert got == [21, 23, 24, 27, 28, 29, 30, 31]
    new = spark.createDataFrame([(d(21), "success", 3, 7), (d(23), "success", 1, 8)], "d date, status string, attempts int, row_count int")
    merged = {r.d.day: (r.status, r.attempts) for r in quality.merge_log(log, new).collect()}
    assert merged[21] == ("success", 5) and merged[23] == ("success", 1) and merged[20] == ("success", 1)


def test_upsert(spark):
    base = spark.createDataFrame([(1, "real", 5, "o"), (2, "x", 6, "o")], "k int, name string, v int, owned string")
    delta = spark.createDataFrame([(1, "Broker 1", None, "n", 1), (3, "new", 7, "n", 1), (3, "newer", 8, "n", 2)], "k int, name string, v int, owned string, seq int")
    out = store.upsert(base, delta, ["k"], preserve=["v"], protect=["owned"], placeholder={"name": F.col("name").startswith("Broker ")}, order="seq")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "real", 5, "o"), (2, "x", 6, "o"), (3, "newer", 8, "n")]
    again = store.upsert(out, delta, ["k"], preserve=["v"], protect=["owned"], placeholder={"name": F.col("name").startswith("Broker ")}, order="seq")
    assert again.exceptAll(out).count() == 0


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.replace_partitions(spark.createDataFrame([("2026-01-01", "A", 1), ("2026-01-02", "A", 2)], "d string, sym string, v int"), path)
    store.replace_partitions(spark.createDataFrame([("2026-01-02", "B", 3)], "d string, sym string, v int"), path)
    got = sorted((str(r.d), r.sym, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("2026-01-01", "A", 1), ("2026-01-02", "B", 3)]


def test_exports(spark, bars, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5), ('say "x"', None)], "t string, v double")
    store.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith('"﻿t"') or text.startswith('﻿"t"') and '"a,b"' in text
    store.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    store.write_bars(bars, str(tmp_path / "bars"))
    plan = spark.read.parquet(str(tmp_path / "bars")).filter("year = 2024 and sym = 'AAAA'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(sym,AAAA)" in plan


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_headers_and_separators(spark, tmp_path, sep):
    accepted = {
        "d": ["date", "trading date", "Trade Date", "tanggal"], "sym": ["code", "ticker", "symbol", "Stock_Code", "kode saham"], "name": ["name", "company", "company name", "nama perusahaan"],
        "prev": ["previous", "prev", "previous price", "sebelumnya"], "open": ["open", "Opening Price", "harga pembukaan"], "first": ["first", "first trade", "perdagangan pertama"],
        "high": ["high", "Highest", "harga tertinggi"], "low": ["low", "lowest", "harga terendah"], "close": ["close", "closing price", "harga penutupan"], "change": ["change", "perubahan"],
        "value": ["value", "trading value", "nilai transaksi"], "freq": ["frequency", "freq", "frekuensi"], "index_indiv": ["individual index", "indeks individual"],
        "offer": ["offer", "ask", "penawaran jual"], "offer_vol": ["offer volume", "ask volume", "volume penawaran jual"], "index_weight": ["index weight", "bobot indeks"],
        "bid": ["bid", "penawaran beli"], "shares": ["listed shares", "saham tercatat"], "fsell": ["foreign sell", "jual asing"], "delisted": ["delisting date"],
    }
    for k in range(5):
        names = {c: a[min(k, len(a) - 1)] for c, a in accepted.items()}
        given = {c: "2026-01-05" if c in ("d", "delisted") else "AB" if c in ("sym", "name") else "3" for c in accepted}
        folder = tmp_path / f"{k}"
        folder.mkdir()
        (folder / "x.csv").write_text(sep.join(names.values()) + "\n" + sep.join(given.values()) + "\n")
        row = landing.read_bars(spark, str(folder)).first()
        assert [c for c in accepted if row[c] is None] == []


def test_files_of_several_layouts(spark, tmp_path):
    day = dt.date(2026, 1, 5)
    (tmp_path / "a b.csv").write_text("Date,Stock Code,Close,Volume\n2026-01-05,AAAA,100,7\n2026-01-05,AAAB,101,8\n")
    (tmp_path / "b.csv").write_text("Date,Stock Code,Volume,Close\n2026-01-05,BBBB,200,9\n")
    (tmp_path / "c.csv").write_text("Stock_Code;note;TANGGAL;Penutupan\nCCCC;x;2026-01-05;300\n", encoding="utf-8-sig")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.csv").write_text("ticker|date|volume\r\nDDDD|2026-01-05|11\r\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("Trade Date,Code,Price,Volume,Close,Date\n2020-01-01,FFFF,1,2,3,2026-01-05\n")
    got = {r.sym: (r.d, r.close, r.volume) for r in landing.read_bars(spark, str(tmp_path)).collect()}
    assert got == {"AAAA": (day, 100.0, 7), "AAAB": (day, 101.0, 8), "BBBB": (day, 9.0, 200), "CCCC": (day, 300.0, None), "DDDD": (day, None, 11), "FFFF": (day, 3.0, 2)}
    (tmp_path / "g.csv").write_text("Date,Close\n2026-01-05,1\n")
    with pytest.raises(ValueError, match="g.csv.*sym"):
        landing.read_bars(spark, str(tmp_path))


def test_a_folder_of_many_files_of_one_layout_is_one_scan(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.csv").write_text(f"Date,Code,Close\n2026-01-{i + 1:02d},A{i},{i}\n")
    df = landing.read_bars(spark, str(tmp_path))
    assert df.count() == 12 and df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    (tmp_path / "empty").mkdir()
    assert landing.read_bars(spark, str(tmp_path / "empty")).count() == 0


def test_payloads_nested_beyond_the_parser_are_not_lost_silently(spark):
    deep = '{"a": ' * 900 + '[{"code": "DEEP"}]' + "}" * 900
    raw = spark.createDataFrame([(deep,)], "payload string")
    assert landing.extract_records(raw).count() == 1
    assert landing._record_list({"data": {"data": {"data": {"rows": [{"x": 1}]}}}}) == [{"x": 1}]


class Killed(Exception):
    pass


def snapshot_rows(store_):
    return sorted(tuple(r) for r in store_.read().select("d", "sym", "close").collect())


def test_snapshot_commits_are_whole(spark, tmp_path):
    day = lambda n: dt.date(2026, 1, n)
    frame = lambda rows: spark.createDataFrame([(day(n), s, float(c)) for n, s, c in rows], "d date, sym string, close double")
    table = Snapshots(spark, str(tmp_path))
    assert table.log().count() == 0 and table.ledger().count() == 0
    hashes = spark.createDataFrame([("h1", "a.csv")], "sha256 string, path string")
    assert table.commit(frame([(1, "A", 1), (1, "B", 2), (2, "A", 3)]), "b1", sources=hashes)
    before = snapshot_rows(table)
    # Killed between the two halves: neither rows nor log row nor ledger show.
    late = spark.createDataFrame([("h2", "b.csv")], "sha256 string, path string")
    table.prepare(frame([(2, "A", 99), (3, "C", 4)]), "b2", late)
    assert snapshot_rows(table) == before and table.log().count() == 2 and [r.sha256 for r in table.ledger().collect()] == ["h1"]
    # Repeated with its final content, and once more: the same table.
    for first in (True, False):
        assert table.commit(frame([(2, "A", 5), (3, "C", 4)]), "b2", spark.createDataFrame([(day(4),)], "d date"), late) is first
        assert snapshot_rows(table) == [(day(1), "A", 1.0), (day(1), "B", 2.0), (day(2), "A", 5.0), (day(3), "C", 4.0)]
        assert [(r.d, r.batch, r.row_count) for r in table.log().orderBy("d").collect()] == [
            (day(1), "b1", 2), (day(2), "b2", 1), (day(3), "b2", 1), (day(4), "b2", 0)]
    assert sorted(r.sha256 for r in table.ledger().collect()) == ["h1", "h2"] and table.verify().count() == 0
    assert table.obsolete().count() == 0
    table.commit(frame([(5, "Z", 1)]), "b3", spark.createDataFrame([(day(1),)], "d date"))  # a date is emptied
    assert day(1) not in {r[0] for r in snapshot_rows(table)} and [r.batch for r in table.obsolete().collect()] == ["b1"]
    for f in (tmp_path / "data" / "batch=b3").rglob("part-*"):
        f.unlink()
    for f in (tmp_path / "data" / "batch=b3").rglob(".part-*"):
        f.unlink()
    assert [(r.d, r.found) for r in table.verify().collect()] == [(day(5), 0)]
