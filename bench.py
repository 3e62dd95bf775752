"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. Results go to Spark's noop
sink, so each time covers the whole query and no transfer to Python.
"""

from __future__ import annotations

import json
import os
import time

from flowkit.catalog import QUERIES
from flowkit.session import local_session

HEADLINE = [
    "clean_split_report",
    "j1_clean_table",
    "d1_dedup",
    "d4_dedup_ignoring",
    "d6_merge_sources",
    "d7_exclude_known",
    "j10_merge_perturbed",
    "a7_crosstab",
    "a9_source_overlap",
    "w1_split_by_label",
    "w3_cap_per_label",
    "w4_shuffle",
    "w11_balance_sources",
    "e3_standardize",
    "e4_quantile_uniform",
    "e13_encode_majority",
    "e15_prepare_training",
    "k2_fit_clusters_flows",
    "k2_many_clusters",
    "k3_distance_to_center",
    "k7_compress_diverse",
    "k10_density_filter_flows",
    "k11_boundary_score",
    "k15_distance_report_by_label",
    "g8_interpolate",
    "m1_merge_train",
    "m4_combine_weighted",
    "m9_robustness_table",
    "m11_ensemble_asr",
    "l1_clean_stream",
]

MAIN_TABLE = {
    "clean_split_report": "lineitem",
    "w1_split_by_label": "lineitem",
    "w4_shuffle": "lineitem",
    "k10_density_filter_flows": "lineitem",
    "k2_fit_clusters_flows": "lineitem",
    "k2_many_clusters": "lineitem",
    "e3_standardize": "lineitem",
    "j1_clean_table": "events",
    "m11_ensemble_asr": "orders",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    smoke = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(smoke):  # load classes and start the threads before the clock runs
        QUERIES[names[0]](spark, smoke).collect()
    times, rates = {}, {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if name in MAIN_TABLE:
            rows = spark.read.parquet(f"{folder}/{MAIN_TABLE[name]}.parquet").count()
            rates[name] = round(rows / times[name])
    print(json.dumps({
        "metric": "flowkit headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows_per_sec": rates,
        "sf": os.path.basename(folder.rstrip("/")),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
