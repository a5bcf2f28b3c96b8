"""Wall seconds per registered query; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_ONLY a comma list of name prefixes.
"""

from __future__ import annotations

import json
import os
import time

from rolecall.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    only = tuple(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = local_session(cores, shuffle_partitions=cores)

    from rolecall.plans import QUERIES

    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name, plan in QUERIES.items():
        if only and not name.startswith(only):
            continue
        start = time.perf_counter()
        plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
