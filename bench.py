"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``: one warm-up, then best of ``$BENCH_REPEATS`` (3).
Every run executes the whole plan with the no-op sink (nothing is
collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fairlend.plans.catalog import QUERIES  # noqa: E402
from fairlend.plans.session import build_session  # noqa: E402

HEADLINE = [
    "county_gap_top25",      # R2 flagship: clean → group → having → top-k
    "county_left_join",      # R2 report: dimension ⟕ gaps
    "ranked_gap_table",
    "clean_audit",           # preparation audit, one pass
    "approval_by_race",      # descriptive tables
    "summary_statistics",    # exact distributed quartiles of four measures
    "binary_metrics",        # rank-sum AUC
    "approval_model",        # R1: logistic fit (328-slot analogue)
    "rate_model",            # R3: linear fit
]


def prepared_gaps(spark, prepared: str):
    """The flagship over a prepared Parquet table, without the fixture's joins."""
    from fairlend.operators.gaps import county_gaps, top_gaps
    from fairlend.sources.readers import read_parquet_partitioned

    return top_gaps(county_gaps(read_parquet_partitioned(spark, prepared)))


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    extra = {"spark.driver.memory": "8g"}
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")  # opt-in: stage/task times without the UI
    if log_dir:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra=extra)
    results = {}
    for name in names:
        run_once(spark, name, sf_dir)  # warm-up
        results[name] = round(min(run_once(spark, name, sf_dir) for _ in range(repeats)), 3)
    if not sys.argv[1:]:
        from fairlend.plans.fixture import applications
        from fairlend.plans.session import shared_dir
        from fairlend.sources.sinks import write_parquet

        prepared = shared_dir(spark, "bench-prepared")
        write_parquet(applications(spark, sf_dir), prepared, ["state_code", "activity_year"])
        QUERIES["prepared_gaps"] = lambda s, _: prepared_gaps(s, prepared)
        run_once(spark, "prepared_gaps", sf_dir)
        extra_run = {"prepared_gaps": round(min(run_once(spark, "prepared_gaps", sf_dir) for _ in range(repeats)), 3)}
    else:
        extra_run = {}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(results.values()), 3),
        "unit": "sec", "queries": results, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
        "other": extra_run, "cpus": cpus, "spark": spark.version, "shuffle_partitions": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
