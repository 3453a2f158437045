"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from chainwright.plans import QUERIES
from chainwright.session import build_session

HEADLINE = [
    "tk03_distinct_topn",
    "jn01_gated_pairs",
    "jn02_kmer_retrieve",
    "jn09_radius_pairs",
    "ag02_metric_means",
    "ag07_describe_cohort",
    "ag10_funnel",
    "ag20_histogram_prior",
    "wn04_pseudo_torsion",
    "wn06_sliding_rmsd",
    "wn09_fill_gaps_linear",
    "wn17_grouped_temporal_split",
    "st01_rmsd",
    "st02_lddt",
    "sx03_cluster_bootstrap",
    "sx06_primary_inference",
    "sx14_spearman",
    "so03_same_rows",
    "src10_chains_from_atoms",
    "gv08_diff",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, shuffle_partitions=int(cores))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(found.group(1)) if found else None}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
