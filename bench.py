"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import tempfile
import time

from voxelcohort.session import local_session, scratch_scope
from voxelcohort.workload import REGISTERED

HEADLINE = [
    "L04_split_by_existence", "L05_repair_in_parent", "L12_link_timeline", "C09_pick_best_mask", "C19_presence_with_seg",
    "A01_select_anchor", "A05_anchor_roles", "A07_compose_chain", "I01_plan_incremental", "I03_plan_todo", "I06_apply_updates", "Q01_propagate_flags",
    "V02_entropy", "V04_percentiles", "V05_standardise", "V20_crop_large", "G01_components", "G13_resample_trilinear", "G15_inner_distance",
    "M01_dice", "M03_pairwise_dice", "M05_dice_per_study", "M12_hausdorff95", "P04_validate", "R03_batch_summary",
    "T03_assemble", "T09_aggregate_sequence", "E07_composite_score", "N02_adjacency", "N04_propagate_labels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-shared-")
        spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench", spark__checkpoint__dir=shared)
        spark.sparkContext.setLogLevel("ERROR")
        REGISTERED["C16_value_counts"][0](spark, sf_dir).collect()  # start the JVM's code paths
        seconds = {}
        for name in names:
            start = time.perf_counter()
            with scratch_scope(spark):
                REGISTERED[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
