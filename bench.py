"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion into Spark's ``noop`` sink (full computation, no
collect). The value is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kindred.session import get_spark  # noqa: E402
from kindred.plans.docs import reset_stages  # noqa: E402
from kindred.plans.queries import QUERIES  # noqa: E402

HEADLINE = ["token_freq", "vocab_cut", "tfidf_weights", "pair_distance_cosine",
            "clusters_single", "cluster_report", "pair_distance_jaccard",
            "pair_distance_dense", "nearest_unit", "knn_vote", "clusters_average"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark = get_spark(f"local[{cpus}]", app="kindred-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g", "spark.kindred.scan.tasks": cpus})
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM start-up, not a query
    times = {}
    for n in names:
        reset_stages()  # every timed query builds its whole pipeline
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
