"""Headline timings; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the run.
Every figure covers plan building and execution of the whole query on whole tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.catalog.queries import QUERIES
from culprit.plans import retail
from culprit.plans.suite import run_suite
from culprit.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "test_suite_results",
    "probe_column_stats",
    "probe_dupe_composite",
    "probe_numeric_moments",
    "evidence_fleet",
    "evidence",
    "orphan_fk_count",
    "lineage_walk",
    "fault_null_heavy",
    "fault_dupe_tail",
    "failing_pks_relationships",
    "classify_rank",
    "incidents",
    "triage_retail",
    "failing_tests",
    "metrics_report_fleet",
    "repair_duplicates",
    "repair_orphans",
)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def full_suite(spark: SparkSession) -> None:
    """All 45 labelled trials: inject, test, trace, probe, rank and score."""
    run = run_suite(spark, retail.sources(spark, FOLDER), "full", at=F.lit("2024-01-01"))
    got = run.report().first()
    solved = (got.top1_table_acc, got.row_recall, got.macro_class_f1)
    if (got.n_incidents, *solved) != (45, 1.0, 1.0, 1.0):
        print(f"suite not solved: {got}", file=sys.stderr)


def main() -> None:
    spark = build_session("bench", cpus=CPUS)
    drain(QUERIES["stg_orders"](spark, FOLDER))
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        drain(QUERIES[name](spark, FOLDER))
        times[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    full_suite(spark)
    times["suite_full_45_trials"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
