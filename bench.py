"""Benchmark: every catalogue query on ``$BENCH_SF_DIR`` at ``local[$BENCH_CPUS]``.

Each query is executed in full with the ``noop`` sink (no driver collect);
``$BENCH_RUNS`` timed passes (default 3), per-query median - the median
discards the cold first pass (JIT, file listing).  ``BENCH_WARMUP=1`` adds an
untimed pass first.
Prints ONE JSON line on stdout.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]

    from satledger.session import build_session
    from satledger.plans.catalog import QUERIES

    spark = build_session(f"local[{cpus}]", app="satledger-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g",
                                 "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024)})
    spark.sparkContext.setLogLevel("ERROR")
    names = only or list(QUERIES)

    failed: dict[str, str] = {}

    def run(name: str) -> float | None:
        if name in failed:
            return None
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"bench: {name} failed: {failed[name]}", file=sys.stderr)
            return None
        return time.perf_counter() - t0

    if os.environ.get("BENCH_WARMUP") == "1":
        for n in names:
            run(n)
    times = {n: [] for n in names}
    for _ in range(runs):
        for n in names:
            t = run(n)
            if t is not None:
                times[n].append(t)
    med = {n: round(statistics.median(v), 4) for n, v in times.items() if v and n not in failed}
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "sum_of_query_median_seconds", "value": round(sum(med.values()), 4),
                      "unit": "sec", "queries": med, "sf": sf, "cpus": cpus, "runs": runs,
                      "failed": sorted(failed)}))
    spark.stop()


if __name__ == "__main__":
    main()
