"""Benchmark at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``feature_table`` is the headline: the whole pipeline from the parquet files to the
feature table, with nothing prepared beforehand. The other queries start from staged inputs (contests and
their sides, the ledger and the second source, matchups for reports on them) and run their own operators in full; page extraction also prints its pages.
Code is warmed up on the folder ``$BENCH_WARM_DIR`` (a tenth of the data); times are the median of ``$BENCH_RUNS`` runs (one by default).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
NAMES = ("career_counts", "rolling_last_n", "opponent_profile_asof", "zscore_skill", "adjusted_rolling", "build_matchups", "elo_dynamic_k",
         "elo_features", "latest_snapshot", "binary_metrics", "segment_report", "style_matrix", "stratified_folds", "fair_consensus",
         "match_contest_pair", "match_gaps", "fuzzy_best_match", "ledger_lock", "attach_odds", "top_factors", "extract_event_list",
         "extract_contest_rows", "date_band_join")
# Queries whose input is the table of matchups.
OVER_MATCHED = {"match_gaps"}  # reports on what matching left over
OVER_MATCHUPS = {"latest_snapshot", "binary_metrics", "segment_report", "style_matrix", "stratified_folds", "top_factors"}


def main() -> None:
    from duelframe.plans import load
    from duelframe.plans.tables import Tables
    from duelframe.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Small tables: keep enough partitions to use every core.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB"})
    spark.sparkContext.setLogLevel("OFF")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()

    def timed(run) -> float:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        return round(statistics.median(times), 3)

    registry, inputs = load(), ("contests", "sides", "ledger_contests", "other_source")

    def measured(folder: str) -> tuple[dict[str, float], Tables]:
        result = {"feature_table": timed(lambda: drain(Tables(spark, folder, staged=("sides", "profiled")).feature_table())),
                  "contests": timed(lambda: drain(Tables(spark, folder, staged=False).contests))}
        shared = Tables(spark, folder, staged=(*inputs, "matchups", "matched"))
        for name in (*inputs, "matchups", "matched"):
            getattr(shared, name)
        for name in NAMES:
            held = (*inputs, *(["matchups"] if name in OVER_MATCHUPS else []), *(["matched"] if name in OVER_MATCHED else []))
            result[name] = timed(lambda: drain(registry.plain_types(registry.BUILDS[name](Tables.sharing(shared, held)))))
        return result, shared

    if os.path.isdir(WARM):
        measured(WARM)
    result, shared = measured(FOLDER)
    contests = shared.contests.count()
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(result.values()), 3), "unit": "sec",
                      "queries": result, "sf": os.path.basename(FOLDER), "contests": contests,
                      "feature_table_contests_per_sec": round(contests / result["feature_table"])}))
    spark.stop()


if __name__ == "__main__":
    main()
