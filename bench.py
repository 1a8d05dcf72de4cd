"""Time every bound query and print one JSON line.

``BENCH_SF_DIR`` picks the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma list of queries, ``BENCH_REPEATS`` the runs per query (best one counts).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from daymart.bindings import all_bindings
from daymart.session import build_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    scratch = tempfile.mkdtemp(prefix="spark-bench-")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        {
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": f"{scratch}/checkpoint",
            "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    bindings = all_bindings()
    names = wanted or list(bindings)
    bindings["b1_commerce_daily"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeats):
            start = time.perf_counter()
            bindings[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
