"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout.

`stages` are the tables many queries share (each timed while it is written); `queries` are the times of
the operators on top of them. `value` is the sum of both.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tracklane.plans import catalog

STAGES = ["states", "areas", "frames", "kickoffs", "possession", "duels", "pressing", "pressure", "kicks", "passes",
          "chains", "set_plays", "speed_changes", "dribblings", "cell_seconds", "intervals"]
QUERIES = ["latest_value", "history_n", "asof_join", "active_key_ticks", "debounce", "deadband", "phase_events",
           "store_many", "match_time_progress", "possession_state", "offside_line", "pressing_index", "team_area_hull",
           "team_area_state", "ball_possession_statistics", "pass_statistics", "pass_sequence_statistics",
           "speed_level_statistics", "distance_statistics", "heatmap_rle"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    m = catalog.match(spark, sf_dir)
    stages, times, failed, rate = {}, {}, None, None
    try:
        for name in STAGES:
            start = time.perf_counter()
            getattr(m, name)
            stages[name] = round(time.perf_counter() - start, 3)
            print(f"stage {name} {stages[name]}", file=sys.stderr)
        for name in QUERIES:
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(f"query {name} {times[name]}", file=sys.stderr)
        rate = round(m.states.count() / sum(stages.values()))
    except Exception as e:  # what was measured before is printed, with the name of what failed
        failed = f"{name}: {type(e).__name__}"
        raise
    finally:
        total = round(sum(stages.values()) + sum(times.values()), 3)
        print(json.dumps({
            "metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "stages": stages,
            "readings_per_sec_all_stages": rate, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            **({"failed": failed} if failed else {}),
        }))
    spark.stop()


if __name__ == "__main__":
    main()
