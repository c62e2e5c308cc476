"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from methmix.session import local_session
from methmix.workloads import QUERIES

HEADLINE = [
    "score_region_sample",   # overlap join and scoring
    "atlas_wide",            # reference atlas
    "mixture_scores",        # 5 x 14 x 20 mixtures drawn and scored
    "naive_estimate",
    "nnls_mixtures",
    "huber_mixtures",
    "lod95_detect",
    "lod95_nnls",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    seconds("score_region_sample")  # start the JVM and its workers
    times = {}
    for name in HEADLINE:
        times[name] = seconds(name)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
