"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores.
Every query runs three times with all of its columns computed; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.registry import QUERIES  # noqa: E402
from talktally.session import build_session  # noqa: E402

HEADLINE = (
    "gold_all",
    "gold_boolean",
    "gold_category_array",
    "gold_conversation_count",
    "gate_dedup",
    "derived_period",
    "timing_by_transcript",
    "document_metrics",
    "header_rollup",
    "operator_result_latest",
    "enrichment_read_merge",
    "index_scalar",
    "surface_fields",
    "list_endpoint",
    "list_endpoint_stored",
    "list_by_agent_stored",
    "metrics_endpoint",
    "metrics_endpoint_stored",
    "q_top_customers",
    "q_heatmap_week",
    "normalize_direct_documents",
    "stream_dedup_counts",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = Path(sf_dir).name.removeprefix("sf")
    line = {
        "metric": "sum of median query seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
