"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = """b10_cosine b13_sparsemax b15_residual c7_knn d1_tile_mean d2_tile_q90 d5_proto_sums e3_avg_rank e5_ntile_bins
c7_knn_blocks m9_greedy_clusters h1_temporal_split_events h2_random_split i1_quantile_thr i3_argmax_f1 j1_sample_f1 j4_auroc_ties j5_ap j11_openset k2_concordance
k1_bootstrap_drawn l2_grid_tiles l5_flatten_divide l12_embed_frames m2_hybrid n1_fit_unmix o4_presence o6_lco o10_openset
o11_openset_sweep j12_discovery o14_nested_cv""".split()


def main() -> None:
    from tessella.catalog import load
    from tessella.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = load()
    only = sys.argv[1:] or HEADLINE
    run = lambda n: queries[n].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("b10_cosine")  # start the JVM code paths and the Python workers
    seconds = {}
    for name in only:
        t = time.time()
        run(name)
        seconds[name] = round(time.time() - t, 3)
        print(f"{name:28s} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
