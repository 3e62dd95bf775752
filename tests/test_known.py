from functools import reduce

import pytest
from pyspark.sql import DataFrame

from flowkit.operators import dedup, known


@pytest.mark.parametrize("bits", [1 << 16, 8 * (1 << 13)])
def test_equals_the_plain_anti_join(spark, monkeypatch, bits):
    monkeypatch.setattr(known, "MOST_BITS", bits)
    schema = "a int, b string, id int"
    train = spark.createDataFrame([(i % 700, "x" if i % 3 else None, i) for i in range(3000)], schema)
    test = spark.createDataFrame([(i, "y", i) for i in range(500)], schema)
    batch = spark.createDataFrame([(i % 900, ["x", "y", None][i % 3], i) for i in range(2500)], schema).repartition(3)
    seen = known.KnownRows([train, test], ["a", "b"])
    got = seen.exclude(batch)
    assert got.columns == batch.columns
    want = dedup.exclude_known_multi(batch, [train, test], ["a", "b"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count()
    seen.add(batch.where("id < 1000"))
    want = reduce(lambda d, b: dedup.exclude_known(d, b, ["a", "b"]), [train, test, batch.where("id < 1000")], batch)
    assert sorted(map(repr, seen.exclude(batch).collect())) == sorted(map(repr, want.collect()))


def test_without_known_rows(spark):
    batch = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "a int, b string")
    assert known.KnownRows([], ["a", "b"]).exclude(batch).count() == 3
    empty: list[DataFrame] = [batch.limit(0)]
    assert known.KnownRows(empty, ["a", "b"]).exclude(batch).count() == 3


def test_filter_rules_out_most_new_rows(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "a")
    seen = known.KnownRows([rows], ["a"])
    assert 0.1 < (seen.filter > 0).mean() < 0.95
    new = spark.range(20_000, 40_000).withColumnRenamed("id", "a")
    assert seen.exclude(new).count() == 20_000 and seen.exclude(rows).count() == 0
