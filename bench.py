"""Time the headline queries and print one JSON line.

BENCH_SF_DIR    table folder (default /root/testdata/sf0.1)
BENCH_CPUS      local cores (default 8)
BENCH_QUERIES   comma list of queries, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxelloom import build_session  # noqa: E402
from voxelloom.plans.all_queries import QUERIES  # noqa: E402

HEADLINE = [
    "slice_histogram", "volume_and_slice_report", "slice_porosity_stats", "format_report", "region_porosity",
    "region_porosity_of_slices", "otsu_threshold", "match_histogram", "value_histogram", "cdf", "overall_box",
    "roi_box_mask", "fit_to_size", "resample_bilinear", "rotate_plane", "binary_open", "gaussian_blur_3d",
    "preprocess_image", "local_thickness", "aggregate_psd", "segment_volume", "combined_loss", "best_checkpoint",
    "train_val_split", "read_specs", "solve_bin_porosities", "method_summary", "mesh_volume_area", "mesh_section_area",
    "nearest_neighbour_distance", "boxplot_stats", "rename_conflicts",
]


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute every row of a query without writing it anywhere."""
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for warm in ("slice_histogram", "gaussian_blur_3d"):
        run(spark, warm, sf_dir)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
