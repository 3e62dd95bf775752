import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.operators import compress


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        c = int(min(rng.exponential(2), 7))
        rows.append((i, "hot" if i % 3 else "cold", c, float(round(rng.exponential(), 3)), [float(x) for x in rng.normal(c, 1, 4)]))
    return spark.createDataFrame(
        rows, "id int, Label string, cluster int, dist double, features array<double>"
    ).cache()


def test_cluster_count():
    assert compress.n_clusters(1000, 60) == 20 and compress.n_clusters(1000, 60, "core") == 60
    assert compress.n_clusters(5, 60, "core") == 5 and compress.n_clusters(100, 9, explicit=4) == 4
    with pytest.raises(ValueError):
        compress.n_clusters(10, 5, explicit=0)


def test_edges_are_at_or_beyond_the_percentile(placed):
    rows = placed.toPandas()
    got = {r["id"] for r in compress.edge_candidates(placed, 90.0).collect()}
    want = set()
    for _, g in rows.groupby("cluster"):
        want |= set(g.id[g.dist >= np.percentile(g.dist, 90) - 1e-12])
    assert got == want


@pytest.mark.parametrize("budget", [3, 20, 60, 1000])
@pytest.mark.parametrize("strategy", ["diverse", "core"])
def test_budget_is_met(placed, budget, strategy):
    sizes = {r["Label"]: r["count"] for r in placed.groupBy("Label").count().collect()}
    cores = {r["Label"]: r["n"] for r in placed.groupBy("Label").agg(F.count_distinct("cluster").alias("n")).collect()}
    out = compress.compress(placed, budget, ["id"], strategy=strategy)
    got = {r["Label"]: r["count"] for r in out.groupBy("Label").count().collect()}
    for label, n in sizes.items():
        want = min(n, max(budget, cores[label]) if strategy == "core" else budget)
        assert got[label] == want
    assert out.select("id").distinct().count() == out.count()


def test_random_fill_and_budget_by_label(placed):
    out = compress.compress(placed, 30, ["id"], strategy="core", fallback="random")
    assert {r["role"] for r in out.collect()} == {"core", "random"} and out.count() == 60
    out = compress.compress(placed, {"hot": 25, "cold": 15}, ["id"])
    assert {r["Label"]: r["count"] for r in out.groupBy("Label").count().collect()} == {"hot": 25, "cold": 15}
    with pytest.raises(ValueError):
        compress.compress(placed, 5, ["id"], strategy="other")


def test_density_filter_parts(placed):
    out = compress.density_filter(placed, ["id"], small_frac=0.05, large_keep=0.1, min_keep=4)
    rows, sizes = out.toPandas(), placed.toPandas().cluster.value_counts()
    small = sizes[sizes <= math.ceil(0.05 * 400)].index
    assert set(rows.cluster[rows.reason == "small"]) == set(small)
    assert (rows.reason == "small").sum() == sizes[small].sum()
    for c in sizes.index.difference(small):
        rest = sizes[c] - ((rows.cluster == c) & (rows.reason == "edge")).sum()
        sampled = ((rows.cluster == c) & (rows.reason == "sample")).sum()
        assert sampled == min(rest, max(4, math.ceil(0.1 * sizes[c])))


def test_boundary_score_values(spark):
    df = spark.createDataFrame([(11.2406,), (0.0479,)], "d double")
    got = [r[0] for r in df.select(F.round(compress.boundary_score(F.col("d")), 4)).collect()]
    assert got == [0.0817, 0.9543]


def test_coreset(placed):
    left, right = placed.where("Label = 'hot'"), placed.where("Label = 'cold'")
    scored = compress.with_boundary_score(left, right, ["id"])
    pins = compress.pin_boundary(scored, 50, ["id"])
    assert pins.count() == 15
    floor = pins.agg(F.min("boundary_score")).first()[0]
    assert scored.where(F.col("boundary_score") > floor).count() <= 15
    core = compress.coreset(scored, pins, 50, ["id"], algo="full")
    assert core.count() <= 50 and core.where("pinned").count() == 15
    quality = compress.coreset_quality(scored, core, ["id"]).first()
    assert quality["rows"] == core.count() and quality["pins"] == 15
    assert 0 <= quality["radius_p50"] <= quality["radius_p90"] <= quality["radius_p95"]
    assert quality["clusters_kept"] <= quality["clusters"]


def test_kmeans_assignment_is_nearest(placed):
    rows = placed.drop("cluster", "dist")
    model = compress.fit_clusters(rows, 6, ["id"], batch=100)
    centres = np.array(model.clusterCenters())
    for r in compress.assign_clusters(rows, model).collect():
        d = np.sqrt(((np.array(r["features"]) - centres) ** 2).sum(1))
        assert r["dist"] == pytest.approx(d.min()) and r["dist"] == pytest.approx(d[r["cluster"]])


def test_pca(placed):
    assert len(compress.pca(placed, 2).first()["pca"]) == 2


def test_minibatch_uses_every_row_and_can_exceed_a_batch(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (300, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    model = compress.fit_clusters(rows, 200, ["id"], batch=100)
    assert len(model.clusterCenters()) == 200
    placed = compress.assign_clusters(rows, model)
    assert placed.count() == 900 and placed.agg(F.avg("dist")).first()[0] < 0.1
    one = compress.fit_clusters(rows, 1, ["id"], batch=50)
    assert one.clusterCenters()[0] == pytest.approx(x.mean(0))
