"""Run the headline queries on $BENCH_SF_DIR and print one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from plumeflux.plans import QUERIES
from plumeflux.session import local_session

HEADLINE = [
    "k05_match_emissions",
    "k07_compare_summary",
    "k01_clip_granules",
    "k06_colocate_sensors",
    "c01_box_join",
    "c04_mean_within_range",
    "c06_nearest_hour",
    "c08_nearest_overpass",
    "c09_nearest_pixel",
    "c11_grid_interpolation",
    "d02_hourly_totals",
    "d08_scene_background",
    "d11_regression",
    "e02_cumulative_distance",
    "e04_forward_wind",
    "e08_path_outliers",
    "i01_gaussian_fit",
    "i01_gaussian_grid_fit",
    "i05_k04_nox_workflow_analytic",
    "j01_focal_snr",
    "j02_plume_mask",
    "j04_least_cost_spine",
    "k02_cross_sectional_flux",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_ONLY", "")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["d02_hourly_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only.split(",")):
            continue
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
