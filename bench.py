"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fordway.plans import registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The routes rows of the published timings compare to multi_source_*; the rest are the other large operators.
HEADLINES = (
    "roa_overall",
    "multi_source_normal",
    "multi_source_disrupted",
    "district_summary",
    "disrupted_edges_bridges",
    "spatial_inner_join",
    "spatial_left_join",
    "nearest_node",
    "affected_persons",
    "affected_households",
    "grid_sample_cells",
    "clip_lines_rect",
    "argmin_per_group",
    "head_per_group",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["roa_overall"](spark, SF_DIR).collect()  # compile and start the Python workers
    times = {}
    for name in HEADLINES:
        start = time.time()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
