"""Thresholds against plain sorting, with and without refinement, under skew and repeats."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.operators import ranking


def md5(seed, *ids):
    return hashlib.md5("|".join([str(seed), *map(str, ids)]).encode()).hexdigest()


def skewed_rows(n=600):
    """Two thirds of the rows in one group, half of them with one value."""
    rng = np.random.default_rng(5)
    groups = np.where(np.arange(n) % 3 > 0, "hot", np.char.add("g", (np.arange(n) % 7).astype(str)))
    values = np.where(rng.random(n) < 0.5, 1.5, rng.normal(size=n) ** 3)
    return [(int(i), str(g), float(v)) for i, g, v in zip(range(n), groups, values)]


@pytest.fixture
def rows():
    return skewed_rows()


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, g string, v double")


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("refine", [False, True])
def test_hash_take_matches_sort(df, rows, refine, request):
    if refine:
        request.getfixturevalue("small_bands")
    got = {r["id"] for r in ranking.hash_take(df, ["g"], ["id"], 9, 25).collect()}
    want = {
        r[0] for part in by_group(rows).values()
        for r in sorted(part, key=lambda r: md5(9, r[0]))[:25]
    }
    assert got == want


@pytest.mark.parametrize("refine", [False, True])
def test_order_statistics_and_percentiles(df, rows, refine, request):
    if refine:
        request.getfixturevalue("small_bands")
    got = {r["g"]: r for r in ranking.exact_percentiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    for g, part in by_group(rows).items():
        want = np.percentile([r[2] for r in part], [0, 37, 100])
        assert np.allclose([got[g]["a"], got[g]["b"], got[g]["c"]], want)
        assert got[g]["__n__"] == len(part)


@pytest.mark.parametrize("refine", [False, True])
@pytest.mark.parametrize("quota", [1, 40, 10_000])
def test_take_smallest_splits_ties(df, rows, refine, quota, request):
    if refine:
        request.getfixturevalue("small_bands")
    got = {r["id"] for r in ranking.take_smallest(df, ["g"], "v", ["id"], quota).collect()}
    want = {
        r[0] for part in by_group(rows).values()
        for r in sorted(part, key=lambda r: (r[2], md5(42, r[0])))[:quota]
    }
    assert got == want


def test_take_smallest_without_groups(df, rows, small_bands):
    got = {r["id"] for r in ranking.take_smallest(df, [], "v", ["id"], 123).collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: (r[2], md5(42, r[0])))[:123]}


def test_hash_rank_is_dense(df, rows, small_bands):
    got = {r["id"]: r["position"] for r in ranking.hash_rank(df, ["g"], ["id"], 3).collect()}
    for part in by_group(rows).values():
        for i, r in enumerate(sorted(part, key=lambda r: md5(3, r[0])), start=1):
            assert got[r[0]] == i


def test_quota_table_and_absent_groups(spark, df):
    quota = spark.createDataFrame([("hot", 7), ("nobody", 5), ("g0", 0)], "g string, quota bigint")
    got = ranking.hash_take(df, ["g"], ["id"], 1, quota).groupBy("g").count().collect()
    assert [(r["g"], r["count"]) for r in got] == [("hot", 7)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id bigint, g string, v double")
    assert ranking.hash_take(empty, ["g"], ["id"], 1, 5).count() == 0
    assert ranking.take_smallest(empty, [], "v", ["id"], 5).count() == 0
    assert ranking.hash_flag(empty, ["g"], ["id"], 1, 5).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_independent_of_partitioning(spark, df, parts):
    spread = df.repartition(parts, F.rand(parts))
    got = {r["id"] for r in ranking.hash_take(spread, ["g"], ["id"], 9, 25).collect()}
    assert got == {r["id"] for r in ranking.hash_take(df, ["g"], ["id"], 9, 25).collect()}


def test_ids_with_separators_and_nulls_are_told_apart(spark):
    rows = spark.createDataFrame(
        [("p|q", "r"), ("p", "q|r"), (None, "r"), ("r", None), ("\\N", "r"), ("p\\", "q")], "a string, b string")
    assert ranking.hash_take(rows, [], ["a", "b"], 1, 1).count() == 1
    from flowkit.functions import order_hash, row_key

    assert rows.select(order_hash(1, ["a", "b"])).distinct().count() == 6
    assert rows.where("a is null or b is null").select(row_key(["a", "b"])).distinct().count() == 2


def test_null_values_come_last_and_fill_the_quota(spark):
    rows = spark.createDataFrame([(i, None if i < 4 else float(i)) for i in range(10)], "id int, v double")
    got = {r.id for r in ranking.take_smallest(rows, [], "v", ["id"], 9).collect()}
    assert len(got) == 9 and set(range(4, 10)) <= got


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
def test_first_rows_by_ranges(spark, n):
    rows = [(i, None if i % 50 == 0 else (i * 37) % 90) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    want = sorted(map(tuple, df.orderBy("v", "id").limit(n).collect()), key=repr)
    got = sorted(map(tuple, ranking.first_rows(df, ["v", "id"], n, few=-1).collect()), key=repr)
    assert got == want
    assert sorted(map(tuple, ranking.first_rows(df, ["v", "id"], n).collect()), key=repr) == want
