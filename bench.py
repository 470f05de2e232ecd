"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from meterstone.session import build_session  # noqa: E402
from suite.queries import load  # noqa: E402

HEADLINE = [
    "p09_request_cost",
    "n13_n14_cumulative_delta",
    "n16_buckets",
    "n19_sessions",
    "r03_totals",
    "r05_by_agent_model",
    "r06_by_project",
    "r08_top_sessions",
    "r10_overview",
    "r17_heat_month",
    "r18_trend_day",
    "r20_periods",
    "r21_nested",
    "l07_merge_overview",
    "p15_reprice",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-cp-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    # One untimed run brings up the JVM and the generated-code compiler.
    registry["r03_totals"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
