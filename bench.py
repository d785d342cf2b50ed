"""Headline timings: median of three runs after a warm-up, as one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the cores. Results
go to Spark's noop sink, so that every row is computed and none is fetched. With
``--all`` every registered query is timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from drydock.session import local_session
from drydock.workspace import delete_path
from scenarios import ALL

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

HEADLINE = [
    "s2_csv_roundtrip",
    "s4_table_row_counts",
    "j1_inner_join_select",
    "k1_sandbox_clone",
    "k3_replace_sandbox",
    "k6_latest_run_status",
    "k7_latest_per_key",
    "t1_update_markup",
    "t5_insert_select",
    "t6_merge_upsert",
    "t8_multi_table_premium",
    "t9_update_from_join",
    "t10_deduplicate",
    "t11_rewrite_statements",
    "t12_screen_statements",
    "c1_row_count_comparison",
    "c2_new_rows_inspection",
    "c3_mean_drift",
    "c4_sum_comparison",
    "c5_min_max_bounds",
    "c6_value_set_drift",
    "c7_distribution_shift",
    "c8_uniqueness_on_keys",
    "c9_foreign_key_integrity",
    "c10_referential_completeness",
    "r1_evaluate_checks",
    "r3_run_suite",
    "r5_data_dictionary",
]


def timed(spark, name: str) -> float:
    start = time.perf_counter()
    ALL[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    workspace = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(
        CPUS, shuffle_partitions=int(CPUS), app_name="bench",
        **{"spark.drydock.workspace": workspace, "spark.sql.warehouse.dir": workspace},
    )
    names = list(ALL) if "--all" in sys.argv else HEADLINE
    seconds = {}
    for name in names:
        timed(spark, name)
        seconds[name] = round(statistics.median(timed(spark, name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": f"total seconds of {len(seconds)} queries (median of {RUNS})",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    delete_path(spark, workspace)


if __name__ == "__main__":
    main()
