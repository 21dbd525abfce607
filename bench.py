"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from framesift.plans import load_all  # noqa: E402
from framesift.session import local_session  # noqa: E402

HEADLINE = """flagship_speaker_report a12_upsert a16_ledger_scan b3_validate_bundle b6_check_intervals
j1_inner_join j5_donor_pool j8_as_of j9_range_join j10_lag_join c1_interval_union c2_mismatch_sweep
c6_speech_regions c13_fill_gaps c15_grid_resample c17_overlap_average c29_robust_z c39_pooling
d1_spread d11_components d20_reference g1_batch_status j11_top_matches v2_registry_match l4_video_state
m1_auc m3_eer m9_breakdown m13_localization m19_paired_bootstrap w1_ranking w5_top_k""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "framesift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for name in names:
        began = time.perf_counter()
        catalogue[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "framesift_headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
