"""Time the reports on the tables of one folder; prints one JSON line.

``BENCH_SF_DIR`` names the folder, ``BENCH_CPUS`` the local cores. Loading the
archive is timed as ``load_*``; every report then runs once to completion on
the loaded tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from surtscope import catalog  # noqa: E402
from surtscope.session import build_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1] if len(sys.argv) > 1 else ""
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def clock(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    archive = catalog.Archive(spark, folder)
    clock("load_captures", archive.captures_path)
    clock("load_index", archive.index_path)
    clock("write_capture_files", archive.lines_path)
    clock("load_report_base", archive.report_base)
    for name, query in catalog.queries().items():
        if only not in name:
            continue
        clock(name, lambda q=query: q(spark, folder).write.format("noop").mode("overwrite").save())
    rows = archive.captures().count()
    spark.stop()
    result = {
        "metric": "total_time_all_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "captures": rows,
        "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
