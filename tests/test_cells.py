"""Cells, exact nearest distances and k-means over them."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.operators import compress, kmeans, nearest
from flowkit.operators.cells import CellIndex, CellTree, improve, nearest_centre, squared
from flowkit.staging import stage


def flow_like(n, seed, width=62, modes=60):
    """Rows of 62 columns around a few modes of very different weight and spread."""
    fixed, rng = np.random.default_rng(7), np.random.default_rng(seed)
    centre = fixed.normal(size=(modes, width)) * fixed.uniform(0, 1, width)
    spread = fixed.uniform(0.01, 0.15, modes)
    weight = 1 / np.arange(1, modes + 1)
    mode = rng.choice(modes, n, p=weight / weight.sum())
    return centre[mode] + rng.normal(size=(n, width)) * spread[mode, None]


def brute(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def test_index_is_exact_and_visits_few_pairs():
    a, b = flow_like(1500, 1), flow_like(6000, 2)
    index = CellIndex(b)
    distance, number = index.nearest_with_number(a)
    want = np.sqrt(squared(a, b).min(1))
    assert np.allclose(distance, want, atol=1e-7)
    assert np.allclose(np.sqrt(((a - b[number]) ** 2).sum(1)), distance, atol=1e-12)
    assert index.compared < 0.2 * len(a) * len(b)


@pytest.mark.parametrize(("rows", "copies", "width"), [(1, 1, 3), (2, 1, 1), (5, 400, 62), (700, 1, 2), (300, 1, 40)])
def test_index_on_odd_tables(rows, copies, width):
    rng = np.random.default_rng(rows)
    b = np.repeat(rng.normal(size=(rows, width)) + 1e3, copies, 0)
    a = np.vstack([rng.normal(size=(90, width)) + 1e3, b[:3]])
    assert np.allclose(CellIndex(b).nearest(a), brute(a, b).min(1), atol=1e-9)


def test_tree_rules_out_no_cell_of_a_nearest_row():
    a, b = flow_like(400, 3), flow_like(3000, 4)
    tree = CellTree(b[::6])
    cell, radius, up = tree.place(b)
    at = np.unique(cell)
    tree.set_radii(at, np.array([radius[cell == c].max() for c in at]), np.array([up[cell == c].max() for c in at]))
    distance = np.sqrt(squared(a, b))
    row, open_ = tree.within(a, distance.min(1) * (1 + 1e-6))
    pairs = set(zip(row.tolist(), open_.tolist()))
    assert all((i, cell[j]) in pairs for i, j in enumerate(distance.argmin(1)))
    assert len(pairs) < 0.2 * len(a) * len(tree.centres)


def test_improve_counts_and_keeps_the_best():
    rng = np.random.default_rng(5)
    q, rows = rng.normal(size=(7, 20)), rng.normal(size=(90, 20))
    best, who = np.full(7, np.inf), np.full(7, -1)
    improve(q, best, rows[:40], who, 100)
    improve(q, best, rows[40:], who, 140)
    assert np.allclose(best, brute(q, rows).min(1)) and (who - 100 == brute(q, rows).argmin(1)).all()
    number, distance = nearest_centre(q, rows)
    assert (number == who - 100).all() and np.allclose(distance, best)


@pytest.mark.parametrize("hot", [False, True])
def test_partitioned_search_equals_the_broadcast_one(spark, monkeypatch, hot):
    monkeypatch.setattr(nearest, "CELL_ROWS", 40)
    monkeypatch.setattr(nearest, "PACKED", 16)
    monkeypatch.setattr(nearest, "BLOCKS", 2)
    a, b = flow_like(500, 8, 12), flow_like(900, 9, 12)
    if hot:  # a third of both sides is one point
        a[:170], b[:300] = a[0], b[0]
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id int, features array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "id int, features array<double>")
    want = brute(a, b).min(1)
    for bound in (10 ** 6, 1200):
        got = nearest.nearest_distance(left, right, ["id"], broadcast_values=bound).orderBy("id").toPandas()
        assert list(got.columns) == ["id", "features", "dist"] and len(got) == 500
        assert np.allclose(got.dist, want, atol=1e-9)


def test_kmeans_is_close_to_full_passes_until_rest(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "DIRECT_SEEDS", 16)
    monkeypatch.setattr(kmeans, "SAMPLE_ROWS", 600)
    x = flow_like(4000, 11, 10, 30)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    model = compress.fit_clusters(rows, 60, ["id"])
    full = compress.fit_clusters(rows, 60, ["id"], algo="full")
    mine, theirs = (
        compress.assign_clusters(rows, m).agg(F.sum(F.col("dist") ** 2)).first()[0] for m in (model, full))
    assert len(model.clusterCenters()) == 60
    assert mine <= 1.05 * theirs
    assert all(b <= a * (1 + 1e-9) for a, b in zip(model.inertia, model.inertia[1:]))
    again = compress.fit_clusters(rows.repartition(3), 60, ["id"])
    assert np.allclose(np.array(model.clusterCenters()), np.array(again.clusterCenters()), atol=1e-5)


def test_kmeans_with_few_rows(spark):
    empty = spark.createDataFrame([], "id int, features array<double>")
    assert compress.fit_clusters(empty, 3, ["id"]).clusterCenters() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id int, features array<double>")
    centres = np.array(compress.fit_clusters(same, 4, ["id"]).clusterCenters())
    assert centres.shape == (4, 2) and np.allclose(centres, [1.0, 2.0])


def test_seeds_are_dealt_by_inertia():
    got = kmeans.share_seeds(np.array([100, 5000, 3, 0]), np.array([10.0, 1000.0, 0.0, 0.0]), 40)
    assert got.sum() == 40 and got[1] > got[0] >= 1 and got[2] >= 1 and got[3] == 0
    assert kmeans.share_seeds(np.array([2, 3]), np.array([1.0, 1.0]), 5).tolist() == [2, 3]


def test_farthest_first_covers_like_the_greedy_choice(spark, monkeypatch):
    from flowkit.operators import farthest

    monkeypatch.setattr(farthest, "PROPOSALS", 5)
    x = flow_like(900, 21, 6, 25)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    pins = rows.where("id < 6")
    core = compress.coreset(rows, pins, 40, ["id"], algo="farthest").toPandas()
    assert len(core) == 40 and set(core.id[core.pinned]) == set(range(6)) and core.id.is_unique
    d = brute(x, x[:6]).min(1)
    for _ in range(34):
        d = np.minimum(d, brute(x, x[[d.argmax()]])[:, 0])
    mine = brute(x, np.stack(core.features)).min(1).max()
    assert mine <= 2 * d.max()
    apart = brute(np.stack(core.features[~core.pinned]), np.stack(core.features))
    assert mine <= np.sort(apart, 1)[:, 1].min() / farthest.KEPT + 1e-9


def test_farthest_first_fills_up_with_repeated_rows(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)], "id int, features array<double>")
    core = compress.coreset(rows, rows.where("id = 0"), 8, ["id"], algo="farthest")
    assert core.count() == 8 and core.select("features").distinct().count() == 3
    none = compress.coreset(rows, rows.where("id < 0"), 4, ["id"], algo="farthest")
    assert none.count() == 4 and none.where("pinned").count() == 0


def test_rows_that_no_cell_is_ruled_out_for_need_little_memory():
    rng = np.random.default_rng(3)
    members, rows = rng.normal(size=(40_000, 16)), rng.normal(size=(12_000, 16))
    index = CellIndex(members)
    tracemalloc.start()
    try:
        got = index.nearest(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.allclose(got[:5], np.sqrt(((rows[:5, None] - members) ** 2).sum(2)).min(1))
    assert peak < 80 << 20


def test_blocks_for_open_cells_leave_in_small_batches(spark, monkeypatch):
    """Every left row has to visit most cells, and a batch holds one block."""
    monkeypatch.setattr(nearest, "OPENED", 1)
    monkeypatch.setattr(nearest, "CELL_ROWS", 20)
    staged = []
    monkeypatch.setattr(nearest, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(60, 12)), rng.normal(size=(300, 12))
    left, right = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>") for x in (a, b))
    got = nearest.nearest_distance(left, right, ["id"], broadcast_values=500).orderBy("id").toPandas()
    assert np.allclose(got["dist"], np.sqrt(((a[:, None] - b) ** 2).sum(2)).min(1))
    first = next(s for s in staged if s.columns == ["cell", "k", "m", "best"])  # no row for any further cell
    assert first.selectExpr("sum(octet_length(k)) / 8").first()[0] == 60
