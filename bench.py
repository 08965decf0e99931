"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import statistics
import sys
import time

from barscope.plans.catalog import QUERIES
from barscope.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "w21_rank_scores", "w20_score_prescreened", "w17_rule_details", "i8_compute_all", "t10_ema", "r3_weeks_with_gaps",
    "w25_rank_vol", "w27_match_coef", "w22_missing_dates_ranked", "w35_top_scores", "x9_run_prediction", "w28_benchmark_ffill", "w29_custom_groups", "w33_rolling", "x10_predict_ranking", "m3_dataset",
]


def timed(spark, name):
    """Median of several runs after one warm-up; all columns are computed."""
    took = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        QUERIES[name].run(spark, SF).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    return round(statistics.median(took[1:]), 3)


def main():
    spark = local_session(CPUS, "bench")
    names = sys.argv[1:] or HEADLINE
    seconds = {name: timed(spark, name) for name in names}
    print(json.dumps({
        "metric": "sum of medians, headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": SF.rstrip("/").split("sf")[-1],
    }))


if __name__ == "__main__":
    main()
