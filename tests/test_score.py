import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.functions import argmax_class
from flowkit.operators import score
from flowkit.plans import jobs


def probs(spark, rows):
    return spark.createDataFrame(rows, "sample_id int, model string, proba array<double>")


def test_weighted_vote(spark):
    df = probs(spark, [
        (1, "xgb", [0.2, 0.8]), (1, "dnn", [1.0, 0.0]), (1, "odd", [1.0, 0.0]), (1, "catb", [0.1, 0.2, 0.7]),
        (2, "odd", [0.3, 0.7]), (2, "other", [0.5, 0.5]),
    ])
    got = {r["sample_id"]: r for r in score.combine_weighted(df, 2).collect()}
    # three classes and no weight do not count; the sum is divided by 0.3 + 0.1
    assert np.allclose(got[1]["proba"], [(0.06 + 0.1) / 0.4, 0.24 / 0.4]) and got[1]["pred"] == 1
    assert np.allclose(got[2]["proba"], [0.4, 0.6]) and got[2]["pred"] == 1
    for r in got.values():
        assert sum(r["proba"]) == pytest.approx(1.0)


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "p array<double>")
    assert [r[0] for r in df.select(argmax_class(F.col("p"))).collect()] == [0, 2]


def test_metrics(spark):
    y, p = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 0, 0]
    df = spark.createDataFrame(list(zip(y, p)), "y int, pred int")
    m = score.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.5)
    precision, recall = [2 / 4, 1 / 2, 0.0], [2 / 3, 1 / 2, 0.0]
    f1 = [2 * a * b / (a + b) if a + b else 0.0 for a, b in zip(precision, recall)]
    assert m["precision_macro"] == pytest.approx(np.mean(precision))
    assert m["f1_macro"] == pytest.approx(np.mean(f1))
    assert m["f1_weighted"] == pytest.approx(np.average(f1, weights=[3, 2, 1]))


def test_confusion_has_empty_cells(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "y string, pred string")
    got = {(r["y"], r["pred"]): r["n"] for r in score.confusion_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got[("a", "b")] == 1 and got[("c", "c")] == 0


def test_asr(spark):
    df = spark.createDataFrame(
        [("m", 0, 0, 1), ("m", 0, 0, 0), ("m", 1, 0, 0), ("n", 1, 0, 1)],
        "model string, y int, plain_pred int, pert_pred int",
    )
    got = {r["model"]: r["asr"] for r in score.asr(df, ["model"]).collect()}
    assert got == {"m": 0.5, "n": 0.0}  # never right: nothing to lose


def test_grid(spark):
    df = spark.createDataFrame(
        [("m", "fgsm", 0, 0, 1), ("m", "fgsm", 1, 1, 1), ("n", "fgsm", 1, 1, 1)],
        "model string, attack string, y int, plain_pred int, pert_pred int",
    )
    grid = {r["attack"]: r for r in score.robustness_grid(score.robustness_table(df), ["m", "n"]).collect()}
    assert grid["original"]["m"] == "100.00% (asr:--)"
    assert grid["fgsm"]["m"] == "50.00% (asr:50.00%)" and grid["fgsm"]["n"] == "100.00% (asr:0.00%)"


def test_only_complete_attacks_count(spark):
    plain = probs(spark, [(1, "xgb", [0.9, 0.1]), (1, "dnn", [0.8, 0.2])])
    pert = spark.createDataFrame(
        [(1, "xgb", "full", [0.1, 0.9]), (1, "dnn", "full", [0.4, 0.6]), (1, "xgb", "half", [0.1, 0.9])],
        "sample_id int, model string, attack string, proba array<double>",
    )
    truth = spark.createDataFrame([(1, 0)], "sample_id int, y int")
    out = jobs.robustness_report(plain, pert, truth, 2, ["xgb", "dnn"]).collect()
    assert {(r["model"], r["attack"]) for r in out} == {("xgb", "full"), ("dnn", "full"), ("ensemble", "full")}
    assert all(r["asr"] == 1.0 for r in out)


def test_merge_train_and_sample(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "id int, Label string")
    part = lambda x: rows.where(F.col("Label") == x)
    out = score.merge_train([("a", part("a").union(part("a")))], [("b", "wgan", part("b"))], ["id"])
    assert out.count() == 30 and sorted(r["position"] for r in out.collect()) == list(range(1, 31))
    assert {r["__source__"] for r in out.collect()} == {"major:a", "minor:b:wgan"}
    assert score.sample_test(rows, ["id"], 4).count() == 8


def test_robustness_broadcasts_no_samples(spark):
    """The probabilities are small files before they are exploded per model; the joins must not trust that."""
    ids = spark.range(40).withColumnRenamed("id", "sample_id")
    model = F.explode(F.array(F.lit("xgb"), F.lit("dnn"))).alias("model")
    plain = ids.select("sample_id", model, F.array(F.lit(0.2), F.lit(0.8)).alias("proba"))
    pert = plain.withColumn("attack", F.lit("flip"))
    truth = ids.withColumn("y", (F.col("sample_id") % 2).cast("int"))
    for out in (jobs.robustness_report(plain, pert, truth, 2, ["xgb", "dnn"]), score.ensemble_asr(plain, pert, truth, 2)):
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r["plain_acc"], r["asr"]) for r in out.collect()} == {(0.5, 0.0)}


def test_merged_parts_are_shuffled_once(spark, monkeypatch):
    """Distinct parts united afterwards met in one task; the parts' rows are made distinct in one shuffle."""
    plans = []
    kept = score.stage
    monkeypatch.setattr(score, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    part = spark.range(6).selectExpr("id % 3 AS id", "'a' AS Label")
    out = score.merge_train([("a", part), ("a", part)], [("b", "wgan", part.withColumn("more", F.lit(1)))], ["id"])
    assert plans[0].count("Exchange hashpartitioning") == 1
    rows = [(r["id"], r["__source__"], r["more"]) for r in out.collect()]
    assert sorted(rows, key=str) == sorted(
        [(i, "major:a", None) for i in range(3)] * 2 + [(i, "minor:b:wgan", 1) for i in range(3)], key=str)
    assert sorted(r["position"] for r in out.collect()) == list(range(1, 10))
