"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs twice, the second run counts."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalogue
from tidemark.session import session

HEADLINE = (
    "raw_engagement", "log_minmax_score", "platform_score_topk", "balanced_entity_score", "batch_calibration", "post_score_library", "leaderboard_top1", "fastest_gaining_rerank", "momentum_dod_wow",
    "visible_edges", "partner_chain_edges", "dedupe_survivor", "merge_discovery_rows", "cross_entity_duplicates", "text_fingerprint_groups", "phrase_attribution", "attribution_guard", "anomaly_rules", "coverage_grid", "canonical_url",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
