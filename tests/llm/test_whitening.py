"""Whitening against numpy's symmetric eigensolver."""

import numpy as np
import pytest

from flowkit.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def table(spark, vectors, ids=None):
    rows = [(i, v if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, "c")
            for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(vectors, most=16):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    keep = e > len(v) * 2.3e-16 * max(e[0], 1e-300)
    z = ((n * x - sums) / n) @ u[:, keep] / np.sqrt(e[keep])
    return n, ((n * x - sums) ** 2).sum(1), z, e[keep] / max(np.trace(v), 1e-300)


def got(spark, df):
    rows = sorted(map(tuple, whitening.whiten(df).collect()), key=lambda r: (r[0], r[1]))
    return rows


@pytest.mark.parametrize(("rows", "width"), [(300, 24), (40, 5), (7, 30), (2, 3), (500, 1)])
def test_against_eigh(spark, rows, width):
    rng = np.random.default_rng(rows)
    vectors = (rng.normal(size=(rows, width)) * np.linspace(0.3, 3, width)).astype(np.float32)
    vectors = np.vstack([vectors, vectors[: rows // 2]])  # repeated vectors count once in the fit
    out = got(spark, table(spark, vectors.tolist()))
    n, deviation, z, explained = expected(vectors)
    m = z.shape[1]
    assert [r[:2] for r in out] == [(i, c) for i in range(len(vectors)) for c in range(1, m + 1)]
    assert {r[2] for r in out} == {n}
    assert [r[3] for r in out[::m]] == deviation.tolist()
    mine = np.array([r[4] for r in out]).reshape(-1, m)
    assert np.allclose(mine * np.sign((mine * z).sum(0)), z, atol=1e-8)
    assert np.allclose([r[5] for r in out[:m]], explained, rtol=1e-9)
    assert out[0][6] < 1e-9 and len({r[6] for r in out}) == 1


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    out = got(spark, df)
    n, deviation, z, explained = expected([r["embedding"] for r in rows])
    mine = np.array([r[4] for r in out]).reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * z).sum(0)) - z).max() < 1e-8
    assert [r[3] for r in out[::16]] == deviation.tolist()


def test_unusable_vectors_and_empty_tables(spark):
    good = [[0.1, 0.9, 0.3], [0.7, 0.2, 0.4], [0.5, 0.5, 0.9], [0.1, 0.2, 0.8]]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [0.5, 0.5]]
    out = got(spark, table(spark, good + odd))
    assert {r[0] for r in out} == {0, 1, 2, 3} and out[0][2] == 4
    assert got(spark, table(spark, [])) == []
    assert got(spark, table(spark, odd[:5])) == []
    assert got(spark, table(spark, [[0.5, 0.5]] * 3)) == [], "no variance"
    nulls = whitening.whiten(table(spark, good[:3] + good[:1], [None, 5, 5, 6])).collect()
    assert sorted(str(r[0]) for r in nulls) == ["5"] * 4 + ["6"] * 2 + ["None"] * 2


def test_long_deviations_are_null(spark):
    out = got(spark, table(spark, [[4e7, 0.0], [-4e7, 1.0], [4e7, 2.0]]))
    assert {r[3] for r in out} == {None} and np.isfinite([r[4] for r in out]).all()


def test_many_partitions_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_BYTES", 1)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(200, 6)).astype(np.float32)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = got(spark, table(spark, vectors.tolist()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    z = expected(vectors)[2]
    mine = np.array([r[4] for r in out]).reshape(-1, 6)
    assert np.allclose(mine * np.sign((mine * z).sum(0)), z, atol=1e-8)


@pytest.mark.parametrize("kind", ["random", "equal", "diagonal", "deficient", "graded", "close"])
def test_singular_values_and_directions(kind):
    rng = np.random.default_rng(4)
    d = 40
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    r = {
        "random": lambda: np.linalg.qr(rng.normal(size=(200, d)), mode="r"),
        "equal": lambda: np.linalg.qr(np.diag([2.0] * 5 + [1.0] * (d - 5)) @ turn, mode="r"),
        "diagonal": lambda: np.diag(rng.uniform(1, 2, d)),
        "deficient": lambda: np.vstack([np.linalg.qr(rng.normal(size=(9, d)), mode="r"), np.zeros((d - 9, d))]),
        "graded": lambda: np.linalg.qr(rng.normal(size=(99, d)) * np.logspace(-6, 0, d), mode="r"),
        "close": lambda: np.linalg.qr(np.diag(1 + 1e-10 * np.arange(d)) @ turn, mode="r"),
    }[kind]()
    a, b, w = whitening.bidiagonalize(r)
    assert np.allclose(w.T @ w, np.eye(d), atol=1e-13)
    squares = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(whitening.dqds(a, b), squares, rtol=1e-12, atol=1e-13 * squares[0])
    e, z, trace = whitening.principal_directions(r)
    assert np.allclose(z.T @ z, np.eye(len(e)), atol=1e-10)
    assert np.abs(r.T @ (r @ z) - z * e).max() < 1e-12 * e[0]
    assert trace == pytest.approx((r ** 2).sum())
