"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trackhouse import catalog  # noqa: E402
from trackhouse.operators import inventory  # noqa: E402
from trackhouse.session import local_session  # noqa: E402
from trackhouse.sources import files  # noqa: E402

HEADLINE = (
    "c1_asof_interpolate", "c2_horizon_lookup", "c6_lut_apply", "d1_sample_rate", "d4_class_histogram",
    "d9_iou", "d12_temporal_cutoff", "d22_latency_percentiles", "e1_gap_segments", "e2_smoothing",
    "e4_hold_heading", "e7_temporal_split", "e8_shard_numbering", "e11_rolling_history",
    "f8_hard_examples", "h3_throttle", "waypoint_labels",
)


#: Files of the generated tree for the inventory report; the published figure covers about as many.
INVENTORY_FILES = 72_000


def inventory_tree() -> str:
    """A tree of one-byte files in sequences of 300, below a new scratch folder."""
    root = tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")
    for first in range(0, INVENTORY_FILES, 300):
        folder = os.path.join(root, "leftImg8bit", "train", f"seq{first // 300:04d}")
        os.makedirs(folder)
        for k in range(first, first + 300):
            with open(os.path.join(folder, f"{k:06d}{'_leftImg8bit.jpg' if k % 2 else '_gtFine_polygons.json'}"), "w") as f:
                f.write("x")
    return root


def inventory_report(spark, root: str) -> None:
    """Suffix counts and directory summary of a file tree."""
    tree = files.file_tree(spark, root)
    inventory.suffix_histogram(tree).write.format("noop").mode("overwrite").save()
    inventory.directory_summary(tree).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    # Start the JVM and the Python workers outside the timings.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    if not os.environ.get("BENCH_QUERIES"):
        root = inventory_tree()
        start = time.perf_counter()
        inventory_report(spark, root)
        times["inventory_report"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
