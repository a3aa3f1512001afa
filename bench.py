"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names, or "all") choose what is run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slidelake.catalog.registry import registry  # noqa: E402
from slidelake.session import local_session  # noqa: E402

HEADLINE = (
    "tiling_summary tile_table fingerprint_quick duplicate_groups qc_gate_medium tile_grid tile_coverage tile_coverage_dense "
    "sample_uniform topk_l2norm topk_or_uniform pending_work mask_positions augment_view pad_bags topk_softmax_pool "
    "patient_mean_pool bag_max_pool slide_embeddings cosine_loss raster_qc pixel_metrics kfold_stratified kfold_stratified_group "
    "standardize_fold fold_summary auroc_ovr_macro threshold_metrics qw_kappa classification_report bootstrap_accuracy "
    "bootstrap_auroc bootstrap_cluster_kappa loss_trend throughput_log npy_ingest batch_infer probe_logreg"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    known = registry()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if asked == "all" else asked.split(",") if asked else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # Start the JVM, the Python workers and the code generator outside the timings.
    for warm in ("l2_norm", "tiling_summary", "batch_infer"):
        run(warm)
    times = {n: run(n) for n in names}
    rates = {}
    if "tile_table" in times:
        slides = spark.read.parquet(os.path.join(sf_dir, "supplier.parquet")).count()
        rates["tiling_slides_per_s"] = round(slides / times["tile_table"], 1)
    if "batch_infer" in times:
        tiles = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")).count()
        rates["batch_infer_tiles_per_s"] = round(tiles / times["batch_infer"], 1)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
