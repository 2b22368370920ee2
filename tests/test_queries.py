"""The registry, and Spark against DuckDB on the smallest tables for a spread of queries."""

import os

import duckdb
import pytest

from sparkbars.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SPREAD = ("back_adjusted_bars", "rsi_simple_mean", "adx_14", "symbol_snapshot", "market_breadth_history", "cross_section_ranks", "accumulation_by_period", "broker_months",
          "ownership_changes", "point_in_time_fundamentals", "valuation_history", "growth_screen", "universe_as_of", "forward_labels_dense", "hit_rates", "model_metrics",
          "selected_thresholds", "decision_gate", "upsert_preserving", "tick_day_bars", "payload_fields", "bar_files_of_several_layouts", "json_snapshot_bars", "committed_snapshots", "exported_files", "tick_sessions", "parabolic_sar", "candle_events",
          "rotation_phases", "month_seasonality", "derived_daily_table", "anomaly_proxies", "entry_zone_outcomes", "walk_forward_folds", "walk_forward_rows")


def norm(v):
    if v is None or v != v:
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_registry_is_complete():
    qs = catalogue()
    assert len(qs) > 150
    assert all(q.covers and q.spec for q in qs.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", SPREAD)
def test_spark_equals_sql(spark, name):
    q = catalogue()[name]
    df = q.run(spark, FOLDER)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    con.execute(q.sql())
    columns = [c[0] for c in con.description]
    assert df.columns == columns
    got = sorted(tuple(norm(v) for v in r) for r in df.collect())
    want = sorted(tuple(norm(v) for v in r) for r in con.fetchall())
    assert got == want


CLASSES = {
    "market_regime": ("market_regime", {"HIGH_VOL", "NEUTRAL", "BULL_TREND", "BULL_RANGE", "BEAR_TREND", "BEAR_RANGE"}),
    "rotation_phases": ("phase", {"LEADING", "WEAKENING", "LAGGING", "IMPROVING", None}),
    "universe_of_active_brands": ("status", {"ELIGIBLE", "INSUFFICIENT_HISTORY", "PENNY_STOCK", "SUSPENDED", "GORENGAN_SUSPECTED", "LOW_LIQUIDITY", "CORPORATE_ACTION_WARNING"}),
}
#: Here the smallest class is of open signals, of which only the last sessions hold any.
FEW = {"entry_zone_outcomes": ("zone_status", {"HIT", "MISS", "EXPIRED", "PENDING"})}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
@pytest.mark.parametrize("name", [*CLASSES, *FEW])
def test_twins_reach_every_class(name):
    """A rule that no row meets would be green whatever it says."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    column, classes = (CLASSES | FEW)[name]
    found = dict(con.execute(f"SELECT {column}, COUNT(*) FROM ({catalogue()[name].sql()}) GROUP BY 1").fetchall())
    assert set(found) == classes and min(found.values()) >= (5 if name in FEW else 20), found
