import math

import pytest
from pyspark.sql import functions as F

from flowkit.operators import augment
from flowkit.plans import jobs
from flowkit.spec import DatasetSpec

SPEC = DatasetSpec(name="t", features=("x", "y"), minority=("rare",), majority=("common",))


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(i, float(i), float(i * i), "rare" if i < 12 else "common") for i in range(60)],
        "id int, x double, y double, Label string",
    )


def test_request_sizes(spark):
    assert augment.request_rows(100, 0.3) == 1000
    assert augment.request_rows(1_000_000, 0.3) == 60_000
    assert augment.request_rows(10, 0.0) == 30_000
    df = spark.createDataFrame([(100, 0.3), (10, 0.0)], "need int, rate double")
    got = [r[0] for r in df.select(augment.request_size(F.col("need"), F.col("rate"))).collect()]
    assert got == [1000, 30_000]


def test_need(rows):
    assert {r["Label"]: r["need"] for r in augment.need_per_label(rows, 40).collect()} == {"rare": 28, "common": 0}


def test_interpolation_stays_between(rows):
    out = augment.interpolate(rows.where("Label = 'rare'"), 500, ["id"], ["x", "y"])
    assert out.count() == 500
    span = out.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert 0 <= span[0] and span[1] <= 11 and 0 <= span[2] and span[3] <= 121
    assert augment.interpolate(rows.where("id < 0"), 5, ["id"], ["x"]).count() == 0
    assert augment.interpolate(rows.where("id = 3"), 5, ["id"], ["x"]).select("x").distinct().count() == 1


def test_accept_top(rows):
    got = sorted(r["id"] for r in augment.accept_top(rows, ["id"], 0.1, ["Label"], "x").collect())
    assert got == [10, 11, 55, 56, 57, 58, 59]
    assert len(got) == math.ceil(1.2) + math.ceil(4.8)


def test_admit(rows, spark):
    new = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.5), (3, 0.5, 0.5)], "gen_id int, x double, y double")
    got = augment.admit(new, [rows], ["x", "y"], ["gen_id"]).collect()
    assert [r["gen_id"] for r in got] == [2]


def test_loop_gives_exactly_the_need(rows):
    rare = rows.where("Label = 'rare'")
    generate = lambda turn, n: augment.interpolate(rare, min(n, 40), ["id"], ["x", "y"], seed=turn)
    out = augment.augment_until(generate, [rows], ["x", "y"], ["gen_id"], 90)
    assert out.count() == 90 and out.select("x", "y").distinct().count() == 90
    assert out.join(rows, ["x", "y"]).count() == 0


def test_loop_gives_up_without_new_rows(rows):
    same = lambda turn, n: rows.withColumn("gen_id", F.col("id"))
    out = augment.augment_until(same, [rows], ["x", "y"], ["gen_id"], 5, max_rounds=2)
    assert out.count() == 0


def test_label_with_enough_rows_passes(rows):
    out = jobs.augment_label(rows, rows, "rare", 10, None, ["x", "y"], ["gen_id"], SPEC)
    assert out.count() == 12
    grown = jobs.augment_label(
        rows.select("x", "y", "Label"), rows, "rare", 20,
        lambda t, n: augment.interpolate(rows.where("Label = 'rare'"), n, ["id"], ["x", "y"], t),
        ["x", "y"], ["gen_id"], SPEC,
    )
    assert grown.count() == 20


def test_critic_prefers_its_label(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id int, features array<double>")
    critic = augment.fit_critic(rows.where("id >= 20"), rows.where("id < 20"))
    scored = augment.critic_score(rows, critic)
    assert scored.where("id >= 20").agg(F.avg("score")).first()[0] > 0.8


def test_a_shortfall_is_not_silent(rows):
    few = lambda turn, n: augment.interpolate(rows.where("Label = 'rare'"), 3, ["id"], ["x", "y"], seed=1)
    with pytest.raises(ValueError, match="missing"):
        augment.augment_until(few, [rows], ["x", "y"], ["gen_id"], 10)
    out = augment.augment_until(few, [rows], ["x", "y"], ["gen_id"], 10, short="return")
    assert 0 < out.count() <= 3
    assert augment.request_rows(1_000_000, 0.3, most=None) == 10_000_000
