"""Splits, quotas and the balanced selection against step-by-step simulations."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowkit.operators import clean, compress, sample


def md5(seed, *ids):
    return hashlib.md5("|".join([str(seed), *map(str, ids)]).encode()).hexdigest()


@pytest.mark.parametrize(("n", "test"), [
    (10_567_392, 3_170_218), (555, 167), (228, 69), (55, 17), (53, 16), (84, 26),
])
def test_split_sizes(spark, n, test):
    size = spark.range(1).select(F.ceil(F.lit(n) * F.lit(0.3)).alias("t")).first()["t"]
    assert size == test


def test_split_by_label(spark):
    rows = [(i, "big") for i in range(200)] + [(1000, "single"), (2000, "pair"), (2001, "pair")]
    df = spark.createDataFrame(rows, "id int, Label string")
    got = {(r["Label"], r["subset"]): r["count"] for r in sample.split_by_label(df, ["id"]).groupBy("Label", "subset").count().collect()}
    assert got == {("big", "test"): 60, ("big", "train"): 140, ("pair", "test"): 1, ("pair", "train"): 1}


def test_stratified_split_is_exact(spark):
    rows = [(i, "abc"[min(i // 50, 2)]) for i in range(173)]
    df = spark.createDataFrame(rows, "id int, Label string")
    got = {(r["Label"], r["subset"]): r["count"] for r in sample.stratified_split(df, ["id"]).groupBy("Label", "subset").count().collect()}
    assert sum(n for (_, s), n in got.items() if s == "val") == math.ceil(17.3)
    assert got[("a", "val")] == 5 and got[("c", "val")] == 8


def test_quotas(spark):
    labels = spark.createDataFrame([("b",), ("c",), ("a",)], "Label string")
    got = {r["Label"]: r["quota"] for r in sample.allocate_quotas(labels, 10).collect()}
    assert got == {"a": 4, "b": 3, "c": 3}
    assert sample.source_cap(12000, 12) == 2000


def test_cap_keeps_all_when_off(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id int, Label string")
    assert sample.cap_per_label(df, ["id"], 0).count() == 2
    assert sample.cap_per_label(df, ["id"], 1).count() == 1


def simulate(rows, threshold):
    """The three phases, one source after the other, on (id, label, sources)."""
    labels_all = {r[1] for r in rows}
    cap = math.ceil(threshold / max(1, len(labels_all)) * 2.0)
    used, out = set(), []
    for attack in sorted({a for r in rows for a in r[2].split("|")}):
        current, need = {}, threshold
        mine = [r for r in rows if attack in r[2].split("|") and r[0] not in used]
        unique = [r for r in mine if "|" not in r[2]]

        def take(pool, label, n):
            part = sorted((r for r in pool if r[1] == label), key=lambda r: md5(1337, r[0]))[:n]
            for r in part:
                used.add(r[0])
                out.append((r[0], r[1], attack))
            current[label] = current.get(label, 0) + len(part)
            return len(part)

        labels = sorted({r[1] for r in unique})
        target = min(need, len(unique))
        for i, label in enumerate(labels):
            quota = target // len(labels) + (i < target % len(labels))
            have = sum(r[1] == label for r in unique)
            need -= take(unique, label, max(0, min(quota, cap - current.get(label, 0), have)))
        for pool in (unique, [r for r in mine if "|" in r[2]]):
            for label in sorted({r[1] for r in pool}):
                free = [r for r in pool if r[1] == label and r[0] not in used]
                n = max(0, min(len(free), cap - current.get(label, 0), need))
                need -= take(free, label, n)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_balance_sources(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["cw", "fgsm", "pgd"]
    rows = []
    for i in range(220):
        k = rng.choice([1, 1, 2, 3])
        picked = "|".join(sorted(rng.choice(names, size=k, replace=False)))
        rows.append((i, str(rng.choice(["l0", "l1", "l2", "l3"], p=[0.6, 0.2, 0.15, 0.05])), picked))
    df = spark.createDataFrame(rows, "id int, Label string, __attack__ string").withColumn("_key_", F.xxhash64("id"))
    threshold = [10, 40, 60, 500][seed]
    got = sample.balance_sources(df, threshold, ["id"])
    assert sorted((r["id"], r["Label"], r["__attack__"]) for r in got.collect()) == simulate(rows, threshold)
    assert got.select("_key_").distinct().count() == got.count()


def test_shuffle_is_a_permutation(spark):
    df = spark.range(500)
    pos = sorted(r["position"] for r in sample.shuffle(df, ["id"]).collect())
    assert pos == list(range(1, 501))


def test_row_ids_count_from_zero(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, Label string")
    ids = sorted(r["__rowid__"] for r in clean.add_row_id(df, "Label", ["id"]).where("Label = 'a'").collect())
    assert ids == list(range(10))


def rounds(sizes, need):
    """Deal one pick per cluster and turn."""
    out = {c: 0 for c in sizes}
    while need > 0 and any(out[c] < n for c, n in sizes.items()):
        for c in sorted(sizes):
            if need > 0 and out[c] < sizes[c]:
                out[c] += 1
                need -= 1
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(1, 30), min_size=1, max_size=8), need=st.integers(0, 120))
def test_round_robin(spark, sizes, need):
    table = dict(enumerate(sizes))
    counts = spark.createDataFrame([("g", c, n) for c, n in table.items()], "Label string, cluster int, n bigint")
    got = compress.round_robin_quotas(counts, ["Label"], "cluster", F.lit(need)).collect()
    assert {r["cluster"]: r["quota"] for r in got} == rounds(table, need)


def test_null_labels_keep_their_rows(spark):
    rows = spark.createDataFrame([(i, None if i < 4 else "x") for i in range(10)], "id int, Label string")
    parts = sample.split_by_label(rows, ["id"], test_size=0.3)
    assert parts.count() == 10
    assert {(r.Label, r.subset): r["count"] for r in parts.groupBy("Label", "subset").count().collect()} == {
        (None, "test"): 2, (None, "train"): 2, ("x", "test"): 2, ("x", "train"): 4}
    split = sample.stratified_split(rows, ["id"], val_size=0.3)
    assert split.where("subset = 'val'").count() == 3
