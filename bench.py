"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every result row is produced and dropped (noop sink); each query runs once after a small
warm-up of the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import re
import time

from panescan import checks
from panescan.session import local_session

HEADLINE = [
    "class_stats", "confusion_matrix", "iou_dice", "full_metrics", "dilated_metrics", "binary_pixel_metrics",
    "mask_runs", "merge_highest", "mask_intersection", "error_map", "mask_rule_dataset", "mask_audit",
    "to_gray", "minmax_normalize", "otsu_threshold", "area_threshold", "downscale_area", "resize_nearest", "focal_opening",
    "patch_grid", "boxes_to_patches", "clipped_polygon_area", "screen_best_centred", "category_stats",
    "connected_regions", "region_summary", "object_metrics",
    "softmax_argmax", "vote_pixels", "vote_tiles", "patch_stats", "confidence_bands", "batch_summary", "score_losses", "top_detections",
    "early_stop_epoch", "memory_growth", "final_metrics",
    "path_facts", "resolve_truth_mask_multiclass", "validate_samples", "explode_coco", "train_val_split", "weighted_draw",
    "accept_non_overlapping", "score_patches", "inspect_full_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, "panescan-bench")
    queries, _ = checks.load()

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = re.sub(r"sf[0-9.]+/?$", "sf0.001", sf_dir)
    for name in ("iou_dice", "focal_opening"):
        run(name, small if os.path.isdir(small) else sf_dir)
    times = {name: run(name, sf_dir) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
