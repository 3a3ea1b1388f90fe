"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query writes to the ``noop`` sink, so
all of its rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import re
import time

from millrace import plans
from millrace.session import local_session

HEADLINE = [
    "clean_split_profile",
    "l1_sample_rows",
    "l6_interleave",
    "d2_first_per_prompt",
    "x1_normalize_text",
    "x11_repetition_penalty",
    "f12_repetitive_text",
    "p7_turns_to_messages",
    "c1_tokenize",
    "c7_sample_index",
    "c10_weighted_blend",
    "c24_pack_rows",
    "j14_sample_gather",
    "j7_nearest_other_label",
    "j11_decontaminate",
    "d5_drop_near_duplicates",
    "g5_group_advantage",
    "g12_preference_pairs",
    "a8_best_worst_at_n",
    "a15_off_policy_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8, "millrace-bench")
    registered = plans.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # starts the engine before the first timing
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else None,
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
