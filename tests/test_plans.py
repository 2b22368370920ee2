"""The physical plans that matter at scale: exchanges, pruning, pushed filters."""

import re

import pytest
from pyspark.sql import functions as F

from sparkbars.functions.dates import sessions_cutoff
from sparkbars.operators import features as ft
from sparkbars.operators import labels as lb
from sparkbars.operators import market
from sparkbars.operators import patterns
from sparkbars.operators import scale
from sparkbars.operators import snapshot as sn
from sparkbars.operators import windows as w
from sparkbars.plans import catalogue
from sparkbars.plans.base import Tables
from sparkbars.sources import landing, store, trades

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, bars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "bars")
    bars.withColumn("unused", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_technicals_and_features_shuffle_once(stored):
    for df in (sn.technicals(stored), ft.features(stored)):
        text = plan(df)
        assert len(re.findall(r"Exchange hashpartitioning\(sym", text)) == 1 and text.count("Exchange") == 1
        assert len(re.findall(r"\bSort \[sym", text)) == 1


def test_scans_read_needed_columns_only(stored):
    text = plan(sn.technicals(stored).select("sym", "d", "sma20"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "unused" not in schema and "fbuy" not in schema and "open" not in schema


def test_cutoff_reaches_the_scan(stored):
    text = plan(stored.filter(F.col("d") >= sessions_cutoff(stored, 20)))
    assert "GreaterThanOrEqual(d,ScalarSubquery" in text


def test_top_k_is_cut_before_the_exchange(stored):
    text = plan(scale.top_k(stored, ["d"], [F.desc("value"), F.asc("sym")], 3))
    assert text.count("WindowGroupLimit") == 2


def test_ranked_lists_compute_their_rows_once(stored):
    tech = sn.technicals(stored)
    for df in (market.flow_rankings(tech), market.movers(tech.withColumn("score", F.lit(1.0)))):
        text = plan(df)
        assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 2 and text.count("WindowGroupLimit") == 2


def test_no_cartesian_products(stored):
    for df in (sn.snapshot(stored), ft.features(stored)):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_stored_training_tables_join_without_exchange(spark, stored, tmp_path):
    """Bucketed alike by (symbol, date), features, labels, universe and ranks meet as they lie."""
    features = ft.features(stored).select("sym", "d", "close", "return_5d", "return_20d")
    labelled = lb.labels_fast(stored)
    status = features.select("sym", "d", F.lit("ELIGIBLE").alias("status"))
    ranks = features.select("sym", "d", F.col("return_5d").alias("rank_of_it"))
    lb.store_training("plan_test", 4, features, labelled, status.where("sym <> 'CCCC'"), ranks, str(tmp_path))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(keep, ("-1", "false")):
            spark.conf.set(k, v)
        df = lb.stored_dataset(spark, "plan_test")
        text = plan(df)
        assert text.count("SortMergeJoin") == 3 and "Exchange" not in text and "Bucketed: true" in text
        assert "Exchange" in plan(lb.dataset(features, labelled, status, ranks=ranks))
        want = lb.dataset(features, labelled, status.where("sym <> 'CCCC'"), ranks=ranks).select(*df.columns)
        assert df.count() == want.count() > 300 and df.exceptAll(want).count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
        for part in lb.STORED:
            spark.sql(f"DROP TABLE IF EXISTS plan_test_{part}")


def test_fold_bounds_are_read_once(stored):
    from sparkbars.operators import models as ml
    rows = stored.select("d", F.lit(None).cast("date").alias("exit_date"))
    span = rows.agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    text = plan(ml.fold_rows(rows, ml.folds(stored.sparkSession, F.lit(span.a), F.lit(span.b), 6, 2, 5, 2)))
    assert len(re.findall(r"FileScan", text)) <= 2


def test_parts_per_symbol_follow_the_table(spark, monkeypatch):
    """A task's share of the windows stays the same size however many trades there are, by the exchange that is there anyway."""
    rows = spark.read.parquet(f"{SMALLEST}/lineitem.parquet").count()
    queries = [catalogue()[name] for name in ("market_movers", "accumulation_by_period", "flow_rankings", "identical_breakdown_alarm")]
    before = [sorted(map(tuple, q.run(spark, SMALLEST).collect())) for q in queries]
    exchanges = [plan(q.run(spark, SMALLEST)).count("Exchange hashpartitioning") for q in queries]
    monkeypatch.setattr(trades, "ROWS_A_PART", 500)
    parts = -(-rows // 500)
    for q, rows_before, count in zip(queries, before, exchanges):
        df = q.run(spark, SMALLEST)
        text = plan(df)
        assert len(re.findall(rf"Exchange hashpartitioning\(sym#\d+, {parts}\)", text)) == 1 and text.count("Exchange hashpartitioning") == count
        assert sorted(map(tuple, df.collect())) == rows_before
    assert f", {parts})" not in plan(Tables(spark, SMALLEST).bars(windows=False))


def test_exported_bars_are_worked_out_once(spark, monkeypatch):
    """The text sinks write what the first sink stored, rather than aggregating the trades again."""
    plans = []
    for name in ("write_csv", "write_json"):
        monkeypatch.setattr(store, name, lambda df, path, sink=getattr(store, name): (plans.append(plan(df)), sink(df, path)))
    got = catalogue()["exported_files"].run(spark, SMALLEST)
    assert len(plans) == 2 and not any("lineitem" in p or "Exchange" in p for p in plans)
    assert {r["count"] for r in got.groupBy("kind").count().collect()} == {Tables(spark, SMALLEST).bars().count()}


def test_header_lines_are_found_without_sorting_lines(spark, tmp_path):
    """Several files a task, some empty, one with a header only and one that is its own neighbour's copy."""
    texts = {f"{k}.csv": f"date,code,h{k % 3}\n" + f"2024-01-02,A{k},1\n" * (k * 40) for k in range(9)} | {"none.csv": "", "last.csv": "date;code"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    df = landing.headers(spark, str(tmp_path))
    assert not re.search(r"Sort|Aggregate|Exchange", plan(df))
    got = df.collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.header) for r in got) == sorted((n, x.split("\n")[0]) for n, x in texts.items() if x)


def test_panel_is_one_pass_over_the_trades(spark):
    text = plan(catalogue()["eod_panel"].run(spark, SMALLEST))
    assert len(re.findall(r"FileScan parquet \[l_", text)) == 1 and "round(" not in text


def test_dense_rows_are_never_exchanged(spark, monkeypatch):
    """Bars are stretched over all sessions where they lie by symbol; the calendar goes to them and splits are found on the bars.
    Dates are read from the trades, also where bars are dealt over parts by size."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large tables look too large to be sent
        text = plan(catalogue()["universe_every_date"].run(spark, SMALLEST))
        assert "Exchange" not in text.split("Generate explode")[0]
        assert len(re.findall(r"FileScan parquet \[l_[^\]]*l_extendedprice", text)) == 1
        assert "Exchange" not in plan(catalogue()["training_rows"].run(spark, SMALLEST)).split("Generate explode")[0]
        monkeypatch.setattr(trades, "ROWS_A_PART", 500)
        assert len(re.findall(r"Exchange hashpartitioning\(sym#\d+, d", plan(catalogue()["universe_every_date"].run(spark, SMALLEST)))) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_splits_as_a_column(spark):
    """The flag of each bar is that of the list of actions, over days without trades or shares; stretched rows have none."""
    day = lambda k: f"2024-01-{k:02d}"
    rows = [("A", day(1), 100.0, 5, 1000), ("A", day(2), 0.0, 0, 4000), ("A", day(3), None, 0, None), ("A", day(4), 50.0, 5, 2000), ("A", day(5), 101.0, 5, 1000),
            ("A", day(8), 101.0, 5, 1005), ("B", day(1), 10.0, 0, 500), ("B", day(2), 10.0, 3, 500), ("B", day(5), 10.0, 3, 1000), ("C", day(9), 1.0, 1, 0)]
    bars = spark.createDataFrame(rows, "sym string, d string, close double, volume long, shares long").withColumn("d", F.to_date("d"))
    want = {(r.sym, r.d) for r in w.corporate_actions(bars).filter("confidence = 'HIGH'").collect()}
    marked = w.with_splits(bars, "split")
    assert marked.columns == [*bars.columns, "split"]
    assert {(r.sym, r.d) for r in marked.filter("split = 1").collect()} == want and len(want) == 2
    dense = trades.densify(marked, ("split",))
    assert {(r.sym, r.d) for r in dense.filter("split = 1").collect()} == want and dense.count() > bars.count()


def test_anomalies_exchange_their_bars_once(spark):
    """Medians and cuts per date go to the rows: these are exchanged where trades become bars and nowhere else, in whatever pass."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = catalogue()["anomaly_proxies"].run(spark, SMALLEST)
        df.collect()
        final = plan(df).split("== Initial Plan ==")[0]
        rows = re.findall(r"(ReusedExchange [^\n]*)?Exchange hashpartitioning\(sym", final)
        assert rows.count("") == 1 and "SortMergeJoin" not in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_anomalies_of_the_null_date(spark):
    """Bars without a date are compared with each other, as a group like any other."""
    rows = [(f"S{i}", None if i % 2 else "2024-01-02", 110.0, 100.0, 100.0, float(2 ** (i // 2)), 1, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "sym string, d string, high double, low double, close double, value double, volume long, freq long")
    got = patterns.anomaly_proxies(df.withColumn("d", F.to_date("d")), share=0.2).collect()
    for d in {r.d for r in got}:
        part = sorted((r for r in got if r.d == d), key=lambda r: r.trade_value)
        assert len(part) == 10 and [r.top_value for r in part] == [False] * 8 + [True] * 2
        assert all(abs(r.value_z - 0.6745 * (k - 4.5) / 2.5) < 1e-9 for k, r in enumerate(part))


def test_training_rows_are_one_pass(spark, monkeypatch):
    """Labels go through the exchange of the features: one pass over the trades, no join, and the same rows as joined ones."""
    from sparkbars.operators import models as ml
    from sparkbars.plans.outcomes import MODEL_FEATURES
    seen = []
    monkeypatch.setattr(ml, "walk_forward", lambda df, *args, **kwargs: seen.append(df) or {}["stop here"])
    with pytest.raises(KeyError, match="stop here"):
        catalogue()["walk_forward_logistic"].run(spark, SMALLEST)
    got = seen[0].filter(F.col("label").isin(0, 1))
    text = plan(got)
    assert "Join" not in text and len(re.findall(r"FileScan parquet \[l_", text)) == 1 and text.count("Exchange hashpartitioning") == 2
    bars = Tables(spark, SMALLEST).bars()
    want = lb.dataset(ft.features(bars, MODEL_FEATURES), lb.labels_fast(bars)).select(*got.columns)
    assert got.count() == want.count() > 4000 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("only", [None, ["return_5d", "rsi14"]])
def test_features_carry_labels(spark, bars, only):
    """Columns kept beside the features are those of their rows; bars without an exit have no label and stay."""
    odd = bars.withColumn("close", F.when(F.col("d") == "2024-06-03", None).otherwise(F.col("close")))
    got = ft.features(lb.with_labels_fast(odd), only, lb.OUTCOME)
    assert got.count() == bars.count() - 3 * 4 and got.columns[4:8] == list(lb.OUTCOME)
    left = got.filter("exit_price IS NOT NULL").select("sym", "d", *lb.OUTCOME)
    want = lb.labels_fast(odd).join(got.select("sym", "d"), ["sym", "d"]).select(*left.columns)
    assert left.count() == want.count() and left.exceptAll(want).count() == 0
    assert got.filter("exit_price IS NULL AND label IS NOT NULL").count() == 0 < got.filter("exit_price IS NULL").count()
