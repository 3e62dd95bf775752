import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.operators import clean, dedup, report
from flowkit.operators.nearest import nearest_distance


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(1, 1, "x", "a"), (2, 1, "y", "b"), (3, 1, "y", "a"), (4, 2, "z", "b"), (5, 2, "z", "b")],
        "id int, f int, Label string, __attack__ string",
    )


def test_counts_before_and_after(rows):
    data = rows.select("f", "Label")
    out, rep = dedup.dedup_verified(data)
    assert out.count() == 3
    assert rep.first().asDict() == {"before": 5, "removed": 2, "after": 3, "left": 0}
    assert dedup.count_duplicates(dedup.dedup(out)).first()["has_duplicates"] is False


def test_empty_counts(spark):
    empty = spark.createDataFrame([], "f int")
    assert dedup.count_duplicates(empty).first().asDict() == {
        "rows": 0, "distinct_rows": 0, "duplicates": 0, "has_duplicates": False,
    }


def test_first_row_wins(rows):
    got = {tuple(r) for r in dedup.dedup_by_features(rows, ["f"], ["id"]).collect()}
    assert got == {(1, 1, "x", "a"), (4, 2, "z", "b")}
    last = dedup.dedup_by_features(rows, ["f"], [-F.col("id")]).collect()
    assert {r["id"] for r in last} == {3, 5}


def test_signed_zero_is_one_group(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert dedup.dedup(df).count() == 1


def test_merge_sources(rows):
    got = {r["f"]: (r["Label"], r["__attack__"]) for r in dedup.merge_sources(rows, ["f"], ["id"]).collect()}
    assert got == {1: ("x", "a|b"), 2: ("z", "b")}


def test_merge_sources_leaves_out_null_features(spark):
    df = spark.createDataFrame([(None, "x", "a", 1), (1, "x", "a", 2)], "f int, Label string, __attack__ string, id int")
    assert dedup.merge_sources(df, ["f"], ["id"]).count() == 1


def test_exclude_known(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0), (2, 1.0)], "a int, b double")
    base = spark.createDataFrame([(1, 2.0), (9, 9.0), (1, 2.0)], "a int, b double")
    assert sorted(map(tuple, dedup.exclude_known(df, base, ["a", "b"]).collect())) == [
        (1, 1.0), (2, 1.0), (2, 1.0)
    ]
    more = spark.createDataFrame([(2, 1.0)], "a int, b double")
    assert dedup.exclude_known_multi(df, [base, more], ["a", "b"]).count() == 1


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    b = spark.createDataFrame([(2.5, 7)], "c double, b int")
    out = dedup.union_aligned([a, b])
    assert out.columns == ["a", "b", "c"] and out.count() == 2
    assert dedup.union_train(a, b).columns == ["b", "a"]


def test_unique_and_overlap(rows):
    merged = clean.with_row_key(dedup.merge_sources(rows, ["f"], ["id"]), ["f"])
    unique, overlap = dedup.split_unique_overlap(merged)
    assert [r["f"] for r in unique.collect()] == [2] and [r["f"] for r in overlap.collect()] == [1]


def test_source_overlap_counts_pairs(spark):
    df = spark.createDataFrame([("a|b",), ("a|b|c",), ("c",), ("a|b",)], "__attack__ string")
    got = {r[0]: r.asDict() for r in report.source_overlap(df, ["a", "b", "c"]).collect()}
    assert got["a"]["dup-b"] == 3 and got["c"]["dup-a"] == 1 and got["b"]["dup-b"] == 0


def test_align(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "sample_id int, y int")
    b = spark.createDataFrame([(1, 1), (2, 1)], "sample_id int, p int")
    assert dedup.align_by_id(a, b).count() == 2
    assert dedup.alignment_counts(a, b).first().asDict() == {"n_plain": 3, "n_perturbed": 2, "differs": True}


@pytest.mark.parametrize("bound", [32_000_000, 1])
def test_nearest_distance_both_ways(spark, bound):
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(60, 5)), np.vstack([rng.normal(size=(300, 5)), rng.normal(size=(1, 5)).repeat(80, 0)])
    ldf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(left)], "id int, features array<double>")
    rdf = spark.createDataFrame([([float(x) for x in v],) for v in right], "features array<double>")
    got = {r["id"]: r["dist"] for r in nearest_distance(ldf, rdf, ["id"], broadcast_values=bound).collect()}
    want = np.sqrt(((left[:, None] - right[None]) ** 2).sum(-1)).min(1)
    assert len(got) == 60 and np.allclose([got[i] for i in range(60)], want)


def test_nearest_distance_to_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "id int, features array<double>")
    assert nearest_distance(df, df.where("id = 2"), ["id"]).first()["dist"] is None


def test_crosstab_totals(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "s string, l string")
    got = {r["s"]: tuple(r)[1:] for r in report.crosstab(df, "s", "l").collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 1), "all": (2, 1, 3)}


def test_nearest_distance_of_any_id_both_ways(spark):
    at = "timestamp'2024-05-01 10:00:00.123456'"
    left = spark.sql(f"""SELECT * FROM VALUES ({at}, 1, array(0D, 0D)), (null, 2, array(3D, 4D)), (null, null, array(1D, 0D)),
        ({at}, 1, array(6D, 8D)) AS t(id, part, features)""")
    right = spark.createDataFrame([([0.0, 0.0],), ([0.0, 1.0],)], "features array<double>")
    small, large = (
        sorted(map(repr, nearest_distance(left, right, ["id", "part"], broadcast_values=b).collect())) for b in (100, 1))
    assert small == large and not any("dist=None" in r for r in small)
