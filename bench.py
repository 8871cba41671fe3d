"""Time the registered queries. Prints one JSON line.

    BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local threads (default 8)
    BENCH_ONLY    comma-separated query names (default: all)
    BENCH_RUNS    timed runs per query; the fastest counts (default 2)

Indexes, layouts and extents are built once per session, as a user would; their build is timed apart as
``build_*`` and is not part of the per-query figures. Every query runs in full through a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terrafold.operators import cells  # noqa: E402
from terrafold.plans.session import build_session  # noqa: E402
from terrafold.registry import QUERIES, core  # noqa: E402


# Checked, not timed unless named: one builds nine layouts of an empty and a full table, one has a polygon of as many edges
# as there are points.
UNTIMED = ("every_method_keeps_rows", "polygon_join_many_edges")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session("terrafold-bench", cores=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    drain(core.pts(spark, sf))  # start-up, not timed
    builds = {
        "build_extent": timed(lambda: core.ext(spark, sf)),
        "build_layout_kd": timed(lambda: core.layout(spark, sf)),
        "build_index": timed(lambda: core.index(spark, sf)),
        "build_unit_index": timed(lambda: core.unit_index(spark, sf)),
    }
    p, e = core.pts(spark, sf), core.ext(spark, sf)
    methods = {
        "assign_fixed_stripes": lambda: cells.fixed_stripes(p, e),
        "assign_adaptive_stripes": lambda: cells.adaptive_stripes(p, e),
        "assign_quad_tree": lambda: cells.quad_tree_cells(p, ext=e),
        "assign_kd_tree": lambda: cells.kd_tree_cells(p, ext=e),
        "assign_sort_tiles": lambda: cells.assign_to_boxes(p, cells.sort_tile_boxes(p, ext=e)),
    }
    builds.update({name: min(timed(lambda: drain(make())) for _ in range(runs)) for name, make in methods.items()})

    times: dict[str, float] = {}
    for name in only or [n for n in QUERIES if n not in UNTIMED]:
        QUERIES[name](spark, sf)  # builds what the query shares with others
        times[name] = min(timed(lambda: drain(QUERIES[name](spark, sf))) for _ in range(runs))
    total = sum(times.values())
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 4) for k, v in times.items()},
        "builds": {k: round(v, 4) for k, v in builds.items()},
        "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
