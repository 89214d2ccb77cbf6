"""Time the headline queries on one folder and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from prematch.plans import registry
from prematch.session import local_session

HEADLINE = [
    "c4_duplicate_quarantine", "d5_latest_as_of", "d13_bitemporal_latest", "e1_rolling_form", "e3_form_with_defaults", "e8_ranking_features",
    "e10_market_consensus", "e12_squad_availability", "e18_materialize", "f1_elo_replay", "f4_glicko_replay", "g4_poisson_fit", "g6_score_grid",
    "g13_temperature_grid", "h1_metrics", "h2_calibration_bins", "h3_expanding_folds", "h7_backtest_poisson", "h13_market_benchmark",
    "h16_diagnostic_slices", "h18_feature_drift", "i3_stake_sizing", "i5_settlement", "j5_watch_signals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cores if cores.isdigit() else "8")))
    registry.load()
    registry.QUERIES["h1_metrics"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
