"""Size-checked lookups and what happens beyond the bound."""

import pytest
from pyspark.sql import functions as F

from flowkit import staging
from flowkit.operators import ranking


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"g{i % 9}", float(i % 13)) for i in range(300)], "id int, g string, v double")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_is_the_same_beyond_the_bound(spark, rows, how):
    small = rows.where("g <> 'g3'").groupBy("g").agg(F.count("*").alias("n"))
    near = staging.lookup(rows, small, ["g"], how)
    far = staging.lookup(rows, small, ["g"], how, max_rows=2)
    assert sorted(map(tuple, near.collect()), key=repr) == sorted(map(tuple, far.collect()), key=repr)
    assert "LocalTableScan" in near._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in far._jdf.queryExecution().executedPlan().toString()


def test_bound_is_checked(rows):
    groups = rows.select("g").distinct()
    assert staging.bounded(groups, 9)[1] is True
    table, fits = staging.bounded(groups, 8)
    assert fits is False and table.count() == 9


def test_ranking_with_large_count_tables(rows, monkeypatch):
    want = sorted(r["id"] for r in ranking.hash_take(rows, ["g"], ["id"], 1, 5).collect())
    ranks = {r["id"]: r["position"] for r in ranking.hash_rank(rows, ["g"], ["id"], 1).collect()}
    monkeypatch.setattr(ranking, "HISTOGRAM_ROWS", 1)
    assert sorted(r["id"] for r in ranking.hash_take(rows, ["g"], ["id"], 1, 5).collect()) == want
    assert {r["id"]: r["position"] for r in ranking.hash_rank(rows, ["g"], ["id"], 1).collect()} == ranks


def test_stage_cuts_lineage_in_the_shared_folder(spark, rows):
    table = staging.stage(rows.where("id < 5"))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "stage-" in plan and table.count() == 5
    assert staging.shared_folder(spark).split(":")[-1] in table.inputFiles()[0]


def test_same_result_for_any_shuffle_width(spark, rows):
    seen = []
    for parts in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = ranking.take_smallest(rows, ["g"], "v", ["id"], 7)
        seen.append(sorted(r["id"] for r in got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 63
