"""Headline queries, warm, median of three: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillprint.plans.registry import load  # noqa: E402
from quillprint.session import SPREAD, build_session  # noqa: E402

HEADLINES = [
    "r8_signature_concat_16", "a14_concat_128", "a13_max_16", "r8_signature_pca_concat", "r4_random_projection",
    "e2_many_models", "j6_all_pairs_euclidean", "j6_all_pairs_cosine", "a10_signature_statistics", "a11_entropy",
    "a1_corpus_statistics", "g10_coverage_report", "f7_valid_probes", "j3_align_responses", "s18_requests_chat",
    "v7_greedy_packing", "e6_catalog_entries", "a8_catalog_rollup", "t3_seeded_shuffle", "r1_encode_responses",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          **{"spark.ui.showConsoleProgress": "false", SPREAD: cpus})
    spark.sparkContext.setLogLevel("ERROR")
    known = load()
    seconds = {}
    for name in HEADLINES:
        run, _ = known[name]
        times = []
        for _ in range(repeats + 1):
            started = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
