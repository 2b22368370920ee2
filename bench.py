"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sparkbars.plans import catalogue
from sparkbars.session import build_session

HEADLINE = (
    "symbol_snapshot", "top_condition_scores", "session_returns", "breadth_score", "flow_rankings", "accumulation_by_period", "broker_totals",
    "ownership_changes", "point_in_time_fundamentals", "valuation_windows", "universe_every_date", "cross_section_ranks", "market_features",
    "feature_vector_native", "forward_labels_sparse", "signal_ranking", "signal_maturity", "hit_rates", "model_metrics", "tick_day_bars",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) * 2 if cpus.isdigit() else 16, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue()
    times: dict[str, float] = {}
    # The first query of a session pays for class loading; that is not part of any query.
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
