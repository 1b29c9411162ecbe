"""Time the headline queries and print one JSON line.

Each query is warmed once and timed twice with the noop writer; the better run
counts. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma list) choose data,
cores and queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "clean_and_split", "group_split_ratio", "stratified_train_val", "dataset_from_samples", "leakage_keys",
    "overlapping_rows", "weighted_resample", "classification_metrics", "evaluate_splits", "pose_metrics",
    "dataset_digest", "minmax", "zscore_real", "axis_l2", "temporal_resize_linear", "reduce_axes",
    "hampel_filter", "phase_unwrap", "phase_calibration", "temporal_filter", "pilot_interpolate_complex",
    "extract_segments", "fft", "stft", "dense_doppler", "autocorrelation", "wavelet_scalogram", "radar_cube",
    "music_aoa", "beamform", "sample_rates", "framed_packets", "point_statistics", "auto_align_sequence",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from cellwave.workload import all_queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, timings = all_queries(), {}
    for name in names:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(min(runs[1:]), 4)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
