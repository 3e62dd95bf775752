"""Queries for clustering, compression, density filter and core-set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.registry import query
from flowkit.catalog.sampling import VEC_HASH, placed
from flowkit.catalog.standins import FLOWS, IDS, VECTORS, flows, vectors
from flowkit.operators import compress
from flowkit.operators.cells import matrix, squared
from flowkit.operators.farthest import KEPT
from flowkit.operators.nearest import nearest_distance
from flowkit.operators.ranking import hash_take
from flowkit.staging import stage

ID = ["vec_id"]


def _edge(partition: str, pct: float, where: str = "placed") -> str:
    """Percentile per partition next to the rows, and the test for lying beyond it."""
    return (
        f"SELECT *, quantile_cont(dist, {pct}) OVER (PARTITION BY {partition}) AS cut FROM {where}"
    )


BEYOND = "dist >= cut - abs(cut) * 1e-12::DOUBLE"


@query("k1_n_clusters", f"""WITH {VECTORS}
SELECT "Label", least(count(*), 40)::BIGINT AS core, least(count(*), ceil(40 / 3.0::DOUBLE))::BIGINT AS diverse
FROM vectors GROUP BY "Label" """)
def k1(spark: SparkSession, d: str) -> DataFrame:
    counts = vectors(spark, d).groupBy("Label").count().collect()
    rows = [
        (r["Label"], compress.n_clusters(r["count"], 40, "core"), compress.n_clusters(r["count"], 40))
        for r in counts
    ]
    return spark.createDataFrame(rows, "Label string, core bigint, diverse bigint")


@query("k2_fit_clusters")
def k2(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).drop("cluster")
    model = compress.fit_clusters(rows, 8, ID)
    return compress.assign_clusters(rows, model).groupBy("cluster").agg(
        F.count("*").alias("rows"), F.max("dist").alias("radius")
    )


@query("k2_fit_clusters_flows")
def k2_flows(spark: SparkSession, d: str) -> DataFrame:
    """Full k-means over all flow rows."""
    rows = flows(spark, d).select(*IDS, F.array("quantity", "discount", "tax").alias("features"))
    model = compress.fit_clusters(rows, 12, IDS, algo="full")
    return compress.assign_clusters(rows, model).groupBy("cluster").agg(F.count("*").alias("rows"))


@query("k3_distance_to_center", f"WITH {VECTORS} SELECT vec_id, cluster, dist FROM placed")
def k3(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).select("vec_id", "cluster", "dist")


@query("k4_core_reps", f"""WITH {VECTORS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY "Label", cluster ORDER BY dist, {VEC_HASH}) AS rn FROM placed)
SELECT "Label", cluster, vec_id, dist FROM r WHERE rn = 1""")
def k4(spark: SparkSession, d: str) -> DataFrame:
    return compress.core_reps(placed(spark, d), ID, ["Label", "cluster"])


@query("k5_edge_candidates", f"""WITH {VECTORS}, e AS ({_edge('cluster', 0.95)})
SELECT vec_id, cluster, dist FROM e WHERE {BEYOND}""")
def k5(spark: SparkSession, d: str) -> DataFrame:
    return compress.edge_candidates(placed(spark, d)).select("vec_id", "cluster", "dist")


@query("k6_distribute_edges", f"""WITH {VECTORS}, e AS ({_edge('cluster', 0.8)}),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist DESC, {VEC_HASH}) AS turn FROM e WHERE {BEYOND})
SELECT vec_id, cluster, dist FROM r ORDER BY turn, cluster LIMIT 73""")
def k6(spark: SparkSession, d: str) -> DataFrame:
    edges = compress.edge_candidates(placed(spark, d), 80.0)
    return compress.distribute_edges(edges, 73, ID).select("vec_id", "cluster", "dist")


def compress_sql(budget: int, pct: float, table: str = "placed") -> str:
    """Core, edges in turns, closest rest; the core trimmed to its farthest when too large."""
    return f"""core0 AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY "Label", cluster ORDER BY dist, {VEC_HASH}) AS rn FROM {table}) WHERE rn = 1),
core AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY dist DESC, {VEC_HASH}) AS o FROM core0)
         WHERE o <= {budget}),
room AS (SELECT "Label", greatest(0, {budget} - count(*)) AS need FROM core0 GROUP BY "Label"),
e AS ({_edge('"Label", cluster', pct, table)}),
turns AS (SELECT *, row_number() OVER (PARTITION BY "Label", cluster ORDER BY dist DESC, {VEC_HASH}) AS turn
          FROM e WHERE {BEYOND}),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY turn, cluster) AS o FROM turns) t
           JOIN room USING ("Label") WHERE o <= need),
edges AS (SELECT * FROM picked WHERE vec_id NOT IN (SELECT vec_id FROM core)),
n_edge AS (SELECT "Label", count(*) AS n FROM edges GROUP BY "Label"),
rest AS (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY dist, {VEC_HASH}) AS o FROM {table}
         WHERE vec_id NOT IN (SELECT vec_id FROM core) AND vec_id NOT IN (SELECT vec_id FROM edges)),
topup AS (SELECT * FROM rest JOIN room USING ("Label") LEFT JOIN n_edge USING ("Label")
          WHERE o <= need - coalesce(n, 0)),
chosen AS (SELECT "Label", cluster, vec_id, dist, 'core' AS role FROM core
  UNION ALL SELECT "Label", cluster, vec_id, dist, 'edge' FROM edges
  UNION ALL SELECT "Label", cluster, vec_id, dist, 'topup' FROM topup)"""


@query("k7_compress_diverse", f"WITH {VECTORS}, {compress_sql(60, 0.9)} SELECT * FROM chosen")
def k7(spark: SparkSession, d: str) -> DataFrame:
    return compress.compress(placed(spark, d), 60, ID, pct=90.0)


@query("k7_compress_few_edges", f"WITH {VECTORS}, {compress_sql(90, 0.99)} SELECT * FROM chosen")
def k7_few(spark: SparkSession, d: str) -> DataFrame:
    """Fewer edge rows than room, so the closest rows fill up."""
    return compress.compress(placed(spark, d), 90, ID, pct=99.0)


@query("k7_compress_trimmed", f"WITH {VECTORS}, {compress_sql(6, 0.95)} SELECT * FROM chosen")
def k7_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """More clusters than budget."""
    return compress.compress(placed(spark, d), 6, ID)


@query("k8_compress_core", f"WITH {VECTORS}, {compress_sql(45, 0.95)} SELECT * FROM chosen")
def k8(spark: SparkSession, d: str) -> DataFrame:
    return compress.compress(placed(spark, d), 45, ID, strategy="core")


@query("k8_compress_core_random", f"""WITH {VECTORS},
core AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY "Label", cluster ORDER BY dist, {VEC_HASH}) AS rn FROM placed) WHERE rn = 1),
room AS (SELECT "Label", 45 - count(*) AS need FROM core GROUP BY "Label"),
rest AS (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {VEC_HASH}) AS o FROM placed
         WHERE vec_id NOT IN (SELECT vec_id FROM core))
SELECT "Label", cluster, vec_id, dist, 'core' AS role FROM core
UNION ALL SELECT "Label", cluster, vec_id, dist, 'random' FROM rest JOIN room USING ("Label") WHERE o <= need""")
def k8_random(spark: SparkSession, d: str) -> DataFrame:
    return compress.compress(placed(spark, d), 45, ID, strategy="core", fallback="random")


@query("k8_compress_core_over_budget", f"""WITH {VECTORS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY "Label", cluster ORDER BY dist, {VEC_HASH}) AS rn FROM placed)
SELECT "Label", cluster, vec_id, dist, 'core' AS role FROM r WHERE rn = 1""")
def k8_over(spark: SparkSession, d: str) -> DataFrame:
    """The core alone exceeds the budget and stays whole."""
    return compress.compress(placed(spark, d), 4, ID, strategy="core")


@query("k9_compress_labels")
def k9(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).drop("cluster")
    return compress.compress_labels(rows, {"a": 40, "b": 60}, ID).select("vec_id", "Label")


@query("k9_rows_per_label", f"""WITH {VECTORS}
SELECT "Label", least(count(*), max(budget))::BIGINT AS rows FROM vectors
JOIN (VALUES ('a', 40), ('b', 60)) AS b(l, budget) ON l = "Label" GROUP BY "Label" """)
def k9_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).drop("cluster")
    kept = compress.compress_labels(rows, {"a": 40, "b": 60}, ID)
    return kept.groupBy("Label").agg(F.countDistinct("vec_id").alias("rows"))


@query("k2_fit_report", f"""WITH {FLOWS}
SELECT count(*) AS rows, 12::BIGINT AS clusters, true AS falling, true AS at_rest, true AS near_full FROM flows""")
def k2_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether the passes lower the inertia, end at rest, and come within 5 % of full k-means."""
    rows = stage(flows(spark, d).select(*IDS, F.array("quantity", "discount", "tax").alias("features")))
    square = F.sum(F.col("dist") * F.col("dist"))
    model = compress.fit_clusters(rows, 12, IDS)
    placed = compress.assign_clusters(rows, model).agg(
        F.count("*").alias("rows"), F.countDistinct("cluster").alias("clusters"), square.alias("inertia")).first()
    full = compress.assign_clusters(rows, compress.fit_clusters(rows, 12, IDS, algo="full")).agg(square).first()[0]
    steps = list(zip(model.inertia, model.inertia[1:]))
    out = (placed["rows"], placed["clusters"], all(b <= a * (1 + 1e-9) for a, b in steps),
           steps[-1][0] - steps[-1][1] <= 0.002 * steps[-1][0], placed["inertia"] <= 1.05 * full)
    return spark.createDataFrame([out], "rows long, clusters long, falling boolean, at_rest boolean, near_full boolean")


@query("k2_many_clusters", f"""WITH {FLOWS}
SELECT count(*) AS rows, 1500::BIGINT AS centres, true AS nearest FROM flows""")
def k2_many(spark: SparkSession, d: str) -> DataFrame:
    """1500 clusters of all flow rows: seeds in two levels; every row is placed, and the placing has
    the inertia that the fit ended with, or less."""
    rows = flows(spark, d).select(*IDS, F.array("quantity", F.col("price") / 2000, F.col("discount") * 500, F.col("tax") * 600).alias("features"))
    model = compress.fit_clusters(rows, 1500, IDS)
    return compress.assign_clusters(rows, model).agg(
        F.count("*").alias("rows"), F.lit(len(model.clusterCenters())).cast("long").alias("centres"),
        (F.sum(F.col("dist") * F.col("dist")) <= model.inertia[-1] * 1.0001).alias("nearest"))


@query("k10_density_filter", f"""WITH {VECTORS}, s AS (
  SELECT cluster, count(*) AS size, count(*) <= ceil((SELECT count(*) FROM placed) * 0.1::DOUBLE) AS small
  FROM placed GROUP BY cluster), e AS ({_edge('cluster', 0.92)}),
m AS (SELECT e.*, size, CASE WHEN small THEN 'small' WHEN {BEYOND} THEN 'edge' END AS reason FROM e JOIN s ON e.cluster = s.cluster),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {VEC_HASH}) AS rn FROM m WHERE reason IS NULL)
SELECT vec_id, cluster, reason FROM m WHERE reason IS NOT NULL
UNION ALL SELECT vec_id, cluster, 'sample' FROM r WHERE rn <= greatest(3, ceil(size * 0.2::DOUBLE))""")
def k10(spark: SparkSession, d: str) -> DataFrame:
    kept = compress.density_filter(
        placed(spark, d), ID, small_frac=0.1, large_keep=0.2, min_keep=3
    )
    return kept.select("vec_id", "cluster", "reason")


SCORED = """scored AS (SELECT vec_id, cluster, features, round(d, 6) AS boundary_dist,
    round(1.0::DOUBLE / (1.0::DOUBLE + round(d, 6)), 6) AS boundary_score FROM (
  SELECT a.vec_id AS vec_id, any_value(a.cluster) AS cluster, any_value(a.features) AS features,
         min(list_distance(a.features, b.features)) AS d
  FROM vectors a, vectors b WHERE a.cluster > 1 AND b.cluster <= 1 GROUP BY a.vec_id))"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    near = compress.with_boundary_score(rows.where("cluster > 1"), rows.where("cluster <= 1"), ID)
    rounded = F.round("boundary_dist", 6)
    return near.withColumn("boundary_score", F.round(compress.boundary_score(rounded), 6)).withColumn(
        "boundary_dist", rounded
    )


@query("k11_boundary_score", f"""WITH {VECTORS}, {SCORED}
SELECT vec_id, boundary_dist, boundary_score FROM scored""")
def k11(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("vec_id", "boundary_dist", "boundary_score")


PINS = f"pins AS (SELECT * FROM scored ORDER BY boundary_score DESC, {VEC_HASH} LIMIT 30)"


@query("k12_pin_boundary", f"""WITH {VECTORS}, {SCORED}, {PINS}
SELECT cluster, count(*) AS pins, (SELECT min(boundary_score) FROM pins) AS cutoff FROM pins GROUP BY cluster""")
def k12(spark: SparkSession, d: str) -> DataFrame:
    return compress.pin_report(compress.pin_boundary(scored(spark, d), 100, ID))


@query("k13_coreset")
def k13(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return compress.coreset(rows, compress.pin_boundary(rows, 100, ID), 100, ID).select(
        "vec_id", "pinned"
    )


@query("k13_coreset_farthest", f"""WITH {VECTORS}, {SCORED}, {PINS},
others AS (SELECT vec_id FROM scored WHERE vec_id NOT IN (SELECT vec_id FROM pins))
SELECT vec_id AS pin, 1::BIGINT AS rows, true AS covered FROM pins
UNION ALL SELECT -1, least(count(*), 70), true FROM others""")
def k13_farthest(spark: SparkSession, d: str) -> DataFrame:
    """The pins, the number of other rows (pin -1), and whether no row is farther from the core-set than the
    distances inside it allow for about twice the best radius."""
    rows = scored(spark, d)
    core = stage(compress.coreset(rows, compress.pin_boundary(rows, 100, ID), 100, ID, algo="farthest"))
    near = nearest_distance(rows.select("vec_id", "features"), core, ID, name="reach")
    reach = near.agg(F.max("reach")).first()[0]
    few = core.select("pinned", "features").toArrow()  # as many rows as the budget
    x, pinned = matrix(few.column("features")), few.column("pinned").to_numpy()
    apart = np.sqrt(squared(x, x) + np.diag(np.full(len(x), np.inf)))
    covered = bool(reach <= apart[~pinned].min() / KEPT + 1e-9)
    return core.groupBy(F.when(F.col("pinned"), F.col("vec_id")).otherwise(-1).alias("pin")).agg(
        F.count("*").alias("rows"), F.lit(covered).alias("covered"))


@query("k14_coreset_quality", f"""WITH {VECTORS}, {SCORED}, {PINS},
more AS (SELECT * FROM scored ORDER BY md5(concat_ws('|', '7', vec_id)) LIMIT 40),
core AS (SELECT *, true AS pinned FROM pins UNION ALL
         SELECT *, false FROM more WHERE vec_id NOT IN (SELECT vec_id FROM pins)),
reach AS (SELECT a.vec_id, min(list_distance(a.features, b.features)) AS radius FROM scored a, core b GROUP BY a.vec_id),
sizes AS (SELECT cluster, count(*) AS n FROM scored GROUP BY cluster),
ranked AS (SELECT *, row_number() OVER (ORDER BY n, cluster) <= ceil((SELECT count(*) FROM sizes) * 0.1::DOUBLE) AS small FROM sizes)
SELECT (SELECT count(*) FROM core) AS rows, (SELECT round(avg(boundary_score), 5) FROM core) AS score_mean,
  (SELECT count_if(pinned)::BIGINT FROM core) AS pins, (SELECT count(*) FROM sizes) AS clusters,
  (SELECT count(DISTINCT cluster) FROM core) AS clusters_kept,
  (SELECT count_if(small)::BIGINT FROM ranked) AS small_clusters,
  (SELECT count_if(small AND cluster IN (SELECT cluster FROM core))::BIGINT FROM ranked) AS small_kept,
  {', '.join(f"(SELECT round(quantile_cont(radius, {p}), 5) FROM reach) AS radius_{n}, (SELECT round(quantile_cont(boundary_score, {p}), 5) FROM core) AS score_{n}" for n, p in (('p50', 0.5), ('p90', 0.9), ('p95', 0.95)))}""")
def k14(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    pins = compress.pin_boundary(rows, 100, ID)
    more = hash_take(rows, [], ID, 7, 40).join(pins.select(*ID), ID, "left_anti")
    core = pins.withColumn("pinned", F.lit(True)).unionByName(more.withColumn("pinned", F.lit(False)))
    report = compress.coreset_quality(rows, core, ID)
    doubles = [c for c, t in report.dtypes if t == "double"]
    return report.select(*[F.round(c, 5).alias(c) if c in doubles else c for c in report.columns])


@query("k16_pca")
def k16(spark: SparkSession, d: str) -> DataFrame:
    reduced = compress.pca(vectors(spark, d), 5)
    return reduced.select("vec_id", *[F.col("pca")[i].alias(f"x{i}") for i in range(5)])


@query("k16_pca_report", f"""WITH {VECTORS}
SELECT count(*) AS rows, true AS falling, true AS uncorrelated, true AS within FROM vectors""")
def k16_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether the variances of the components fall, no two are correlated, and they hold no more
    than the variance of the rows."""
    reduced = compress.pca(vectors(spark, d), 5)
    x, v = [F.col("pca")[i] for i in range(5)], F.col("features")
    whole = sum((F.var_pop(v[i].cast("double")) for i in range(1, 64)), F.var_pop(v[0].cast("double")))
    r = reduced.agg(
        F.count("*").alias("n"), whole.alias("whole"), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)],
        *[F.corr(x[i], x[j]).alias(f"c{i}{j}") for i in range(5) for j in range(i)]).first()
    var = [r[f"v{i}"] for i in range(5)]
    out = (r["n"], all(b <= a * (1 + 1e-9) for a, b in zip(var, var[1:])),
           all(abs(r[f"c{i}{j}"]) < 1e-6 for i in range(5) for j in range(i)), sum(var) <= r["whole"] * (1 + 1e-9))
    return spark.createDataFrame([out], "rows long, falling boolean, uncorrelated boolean, within boolean")


@query("k10_density_filter_flows", f"""WITH {FLOWS}, f AS (
  SELECT {', '.join(IDS)}, port % 40 AS cluster, price AS dist FROM flows),
s AS (SELECT cluster, count(*) AS size, count(*) <= ceil((SELECT count(*) FROM f) * 0.025::DOUBLE) AS small FROM f GROUP BY cluster),
e AS ({_edge('cluster', 0.92, 'f')}),
m AS (SELECT e.*, size, CASE WHEN small THEN 'small' WHEN {BEYOND} THEN 'edge' END AS reason FROM e JOIN s ON e.cluster = s.cluster),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(concat_ws('|', '42', {', '.join(IDS)}))) AS rn FROM m WHERE reason IS NULL)
SELECT {', '.join(IDS)}, reason FROM m WHERE reason IS NOT NULL
UNION ALL SELECT {', '.join(IDS)}, 'sample' FROM r WHERE rn <= greatest(50, ceil(size * 0.03::DOUBLE))""")
def k10_flows(spark: SparkSession, d: str) -> DataFrame:
    """The filter over all flow rows with given clusters and distances."""
    rows = flows(spark, d).select(
        *IDS, (F.col("port") % 40).alias("cluster"), F.col("price").alias("dist")
    )
    return compress.density_filter(rows, IDS, small_frac=0.025).select(*IDS, "reason")
