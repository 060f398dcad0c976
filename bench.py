"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ["A4_window_scores", "J2_intersections", "J13_pair_relations", "A35_total_overlap", "J1_pairs_within", "P1_area", "R1_components",
            "R6_separate_instances", "R7_gradient_flood", "R9_guided_cuts", "R3_growth", "R25_hann_blend", "R14_gap_slivers", "W1_snapshot", "W8_accepted_writes", "R30_lineage_sources",
            "A25_centroid_predict", "Q3_manifest_protocol", "R19_faces"]


def main() -> None:
    from gridfold.plans import QUERIES
    from gridfold.session import build_session
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.log.level": "ERROR"})
    names = sys.argv[1:] or HEADLINE
    QUERIES["P1_area"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM once
    took = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
