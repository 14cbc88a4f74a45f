"""Time the headline queries once warm and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from catalog import QUERIES
from vetloom.session import get_spark

HEADLINE = [
    "file_analysis",
    "file_analysis_store",
    "agg_triangular",
    "agg_exponential",
    "top_cwe",
    "word_tokens",
    "token_windows_512_128",
    "lexical_tokens",
    "canonicalize_identifiers",
    "vocabulary",
    "embed_tokens_zero",
    "fix_length_drop",
    "strip_comments",
    "merge_package_source",
    "shannon_entropy_text",
    "package_features",
    "typosquat_pairs",
    "quantile_flags",
    "join_code_verdicts",
    "session_summary",
    "session_detail",
    "route_verdicts",
    "reason_report",
    "balanced_sample_events",
    "stratified_split",
    "classification_report",
    "profile",
    "latest_status",
    "session_timeouts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds[1:] or seconds), 4)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
