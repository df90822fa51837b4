"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lineamix.plans.catalog import QUERIES  # noqa: E402
from lineamix.session import local_session  # noqa: E402

HEADLINE = (
    "clade_freq", "weighted_sample3", "fractions", "top5_other", "stacked_fractions", "mse_by_tool",
    "best_rmse", "max_abundance", "spearman", "call_match", "clade_match", "hom_alt_share",
    "lineage_similarity", "sample_n_reads", "interval_anti", "primer_clip", "mate_pairs",
    "coordinate_sort", "hap_abundance", "read_qc", "quality_filter", "quality_trim",
    "study_simulation_input", "study_abundant_validation", "study_scatter_posterior",
    "study_scatter_abundance", "study_labmix", "study_labmix_posterior", "study_coinfection", "study_similarity",
    "study_genotype_filter", "study_monitoring", "study_hap_abundance", "study_read_mix",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores), memory="16g")
    QUERIES["fractions"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - begin, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
