"""Time the headline queries and print one JSON line.

Each query runs once to warm up, then BENCH_RUNS times into the noop sink; the
median counts. Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerline.plans import catalog  # noqa: E402
from ledgerline.session import build_session  # noqa: E402

HEADLINE = [
    "recent_actions",
    "recent_accounts_by_status",
    "date_breaks",
    "context_search",
    "url_flow_matches",
    "persona_account_counts",
    "found_accounts",
    "entries_of_personas",
    "digest_classes",
    "committed_context",
    "upserted_flows",
    "confidence_trace",
    "confidence_state",
    "stuck_runs",
    "step_history",
    "run_outcomes",
    "page_classes",
    "page_elements",
    "element_matches",
    "trimmed_frames",
    "response_json",
    "timeline_lines",
    "brief_lines",
    "audit_log",
    "replay_results",
    "checkpoint_audit",
    "verified_steps",
    "assigned_ids",
    "live_stuck_alerts",
]


def timed(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "ledgerline-bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        build = catalog.QUERIES[name]
        timed(build, spark, sf_dir)
        seconds[name] = round(statistics.median(timed(build, spark, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
