"""Time the headline queries; prints one JSON line.

Each query runs three times and the median of the last two counts, so code is compiled and files are in
memory. Queries that take longer than REPEAT_LIMIT seconds run once more only. Results go to the no-op
sink, so all rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from spanlens.session import get_session

QUERIES = [
    "time_windows_sliding",
    "clips_fixed_rate",
    "sample_target_frames",
    "recovered_evidence",
    "range_retrieval",
    "point_retrieval",
    "retrieval_metrics",
    "vector_top_k_in_recording",
    "vector_top_k_global",
    "pooled_unit_frames",
    "hybrid_retrieval",
    "clip_mentions",
    "temporal_events",
    "graph_edges",
    "normalized_questions",
    "token_f1",
    "answer_report",
    "paired_report",
    "annotation_questions",
    "event_groups_ranked",
    "graph_evidence",
]

REPEAT_LIMIT = 20


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from spanlens import catalog

    catalog.load_all()
    seconds = {}
    catalog.QUERIES["safe_keys"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(","):
        runs = []
        while len(runs) < (2 if runs and runs[0] > REPEAT_LIMIT else 3):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
