"""Time the stages with published numbers at their published row counts, on local cores.

python tools/scale_run.py <empty folder> [copies]: replicates the sf0.1 line items `copies` times
(20 gives 12 million rows) into the folder and runs split, cleaning and the density filter on them.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from flowkit.catalog.jobs import SPLIT_SPEC  # noqa: E402
from flowkit.catalog.standins import flows  # noqa: E402
from flowkit.operators import clean, compress, dedup, nearest, sample  # noqa: E402
from flowkit.session import local_session  # noqa: E402
from flowkit.staging import stage  # noqa: E402


def main() -> None:
    folder, copies = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 20
    spark = local_session(8, partitions=32, memory="16g", checkpoint=f"{folder}/checkpoint")
    big = flows(spark, "/root/testdata/sf0.1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    # nine of ten rows get one label, as in the published data
    label = F.when(F.pmod(F.xxhash64("copy", "l_orderkey"), F.lit(10)) > 0, "Benign").otherwise(F.col("Label"))
    spread = big.repartition(32).withColumn("Label", label).withColumn(
        "price", F.col("price") + F.col("copy")
    )
    spread.write.parquet(f"{folder}/flows")
    rows = spark.read.parquet(f"{folder}/flows")
    n = rows.count()
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "day", "copy"]

    def timed(name, df):
        start = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        t = time.perf_counter() - start
        print(f"{name:28} {t:8.1f} s {n / t:12.0f} rows/s", flush=True)

    print(f"{n} rows")
    timed("clean and de-duplicate", lambda: dedup.dedup(clean.clean_rows(rows, SPLIT_SPEC)))
    timed("split per label", lambda: sample.split_by_label(rows, ids))
    timed("clean, stage, split", lambda: sample.split_by_label(
        clean.with_row_key(stage(dedup.dedup(clean.clean_rows(rows, SPLIT_SPEC))), ["price", "port", "quantity"]),
        ["_key_"],
    ))
    vectors = rows.select(*ids, F.array("quantity", "discount", "tax", "port").alias("features"))
    placed = vectors.withColumn("cluster", F.col("l_partkey") % 1500)
    start = time.perf_counter()
    placed = stage(compress.distance_to_center(placed, compress.group_centers(placed, 4)).drop("features"))
    t = time.perf_counter() - start
    print(f"{'distance to 1500 centres':28} {t:8.1f} s {n / t:12.0f} rows/s", flush=True)
    timed("density filter, 1500 clusters", lambda: compress.density_filter(placed, ids))
    timed("compress to 28,000", lambda: compress.compress(
        placed.withColumn("Label", F.lit("Benign")), 28_000, ids
    ))
    timed("k-means, k = 1500, and placing", lambda: compress.assign_clusters(
        vectors, compress.fit_clusters(vectors, 1500, ids)))
    few = vectors.where("l_orderkey % 97 = 0 and copy = 1")
    timed("nearest of a small label", lambda: nearest.nearest_distance(vectors, few, ids))
    timed("total shuffle", lambda: sample.shuffle(rows, ids))


if __name__ == "__main__":
    main()
