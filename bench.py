"""Seconds per registered query, each run to completion into a no-op sink.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON
line. Every query runs once to warm up, then ``$BENCH_RUNS`` times; the best counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from harness.catalogue import registered
from pyspark.sql import SparkSession


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or list(registered())
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(1 + runs):
            started = time.perf_counter()
            registered()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times[1:] or times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "master": f"local[{cpus}]",
            }
        )
    )


if __name__ == "__main__":
    main()
