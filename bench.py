"""Time headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terrascope.plans import catalog  # noqa: E402
from terrascope.session import local_session  # noqa: E402

HEADLINE = [
    "scalar_metrics", "oracle_by_split", "average_precision", "per_frame_metrics", "calibrate_unknown", "group_bootstrap_ci",
    "nearest_scan", "pose_interpolation", "disjoint_scan_split", "nearest_z_pixel", "label_projection", "temporal_support",
    "depth_accumulate_trailing", "depth_fuse_symmetric", "depth_support_count", "hole_insertion", "incidence_weight",
    "mask_nms", "joint_partition", "minmax_heat", "neighbour_coherence", "relevancy", "query_preservation", "relevancy_audit",
    "weighted_language_cosine", "covariance_fit", "codebook_kmeans", "observation_ema", "observation_switch", "stream_frame_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's and the Python workers' machinery.
    catalog.REGISTRY["predict_argmax"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for key in keys:
        start = time.time()
        catalog.REGISTRY[key].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - start, 3)
        print(f"{key} {seconds[key]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
