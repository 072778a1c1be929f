"""Headline-query benchmark: prints ONE JSON line.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] (default 8). Every query is executed to completion with the
``noop`` sink (all rows produced, nothing collected); the median of $BENCH_RUNS
warm runs (default 3) after one warm-up is reported per query; the value is the headline queries' total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidepool.plans import load_all  # noqa: E402
from tidepool.session import build_session  # noqa: E402

HEADLINE = ["enrich_messages", "log_query", "reconcile", "snapshot_candidate", "diagnostics_report",
            "related_events", "over_limit", "page_deployments"]
#: Timed beside the headline queries, and not part of their total.
MORE = ["log_last_n", "status_tab_counts"]
STREAMS = ["checkpointed_stream", "reconcile_stream"]  # one run each after one warm-up


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    queries, _ = load_all()
    out = {}
    for name in HEADLINE + MORE + STREAMS:
        times = []
        for i in range((1 if name in STREAMS else runs) + 1):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(out[n] for n in HEADLINE), 3), "unit": "sec",
                      "queries": out, "sf": sf, "cpus": int(cpus), "runs": runs, "spark": spark.version}))


if __name__ == "__main__":
    main()
