"""Times the headline queries and prints one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). Every query runs once to warm
up and is then timed over a full run into a sink that keeps nothing.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plotgrid.plans.catalog import QUERIES  # noqa: E402
from plotgrid.session import local_session  # noqa: E402

HEADLINE = [
    "s3_db_scan_count",
    "f2_bbox_filter_simple",
    "f3_bbox_filter_neighborhood",
    "f3_bbox_filter_municipality",
    "f3_bbox_filter_county",
    "f4_bbox_filter_advanced",
    "f5_compound_filter",
    "a3_grid_aggregate",
    "l1_ordered_range_query",
    "j1_spatial_join_counties",
    "j3_point_in_polygon_counts",
    "j4_points_workload",
    "j10_single_tile",
    "j10_tile_lookup",
    "t2b_conflate_merge",
    "t3a_synthesize_medium",
    "t4c_build_tiles",
    "t6_prepare_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    seconds = {}
    for name in names:
        for _ in range(2):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
