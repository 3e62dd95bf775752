import pytest
from pyspark.sql import functions as F

from flowkit.operators import clean, dedup, score, train
from flowkit.plans import jobs
from flowkit.spec import DatasetSpec
from flowkit.streaming import flows as stream

SPEC = DatasetSpec(name="t", features=("port", "x"), cat=("port",))


def test_stream_equals_batch_over_two_runs(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    cells = [(str(i % 5), ["1.5", "bad", "-1", "2"][i % 4], ["a/x", " b ", "Label", None][i % 4 if i % 3 else 0]) for i in range(60)]
    first = spark.createDataFrame(cells[:30], "port string, x string, Label string")
    second = spark.createDataFrame(cells[30:], "port string, x string, Label string")
    for part in (first, second):
        part.write.mode("append").parquet(src)
        source = stream.read_stream(spark, src, part.schema, files_per_trigger=1)
        stream.clean_stream(source, SPEC, out, log).awaitTermination()
    got = sorted(map(tuple, stream.finish_clean(spark, out).collect()))
    want = sorted(map(tuple, dedup.dedup(clean.clean_rows(first.union(second), SPEC)).collect()))
    assert got == want and got


def test_running_counts(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)], "id int, Label string")
    rows.repartition(3).write.parquet(str(tmp_path / "s"))
    source = stream.read_stream(spark, str(tmp_path / "s"), rows.schema, files_per_trigger=1)
    stream.running_label_counts(source, "Label", "t_counts").awaitTermination()
    assert {r["Label"]: r["rows"] for r in spark.table("t_counts").collect()} == {"a": 5, "b": 4}


def test_merged_counts_survive_a_stop_and_a_batch_run_twice(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    assert stream.read_label_counts(spark, out) is None
    want: dict = {}
    for turn in range(3):
        rows = [(i, ["a", "b", None][(i + turn) % 3]) for i in range(10)]
        for _, x in rows:
            want[x] = want.get(x, 0) + 1
        spark.createDataFrame(rows, "id int, Label string").repartition(2).write.mode("append").parquet(src)
        source = stream.read_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
        stream.merge_label_counts(source, "Label", out, log).awaitTermination()
        if turn == 1:  # as if the last batch had written its table, but not its commit
            commits = sorted((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            commits[-1].unlink()
            (tmp_path / "log" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
        got = {r["Label"]: r["rows"] for r in stream.read_label_counts(spark, out).collect()}
        assert got == want


@pytest.fixture(scope="module")
def xy(spark):
    rows = [(i, [float(i % 30), float((i * 7) % 11)], 0 if i % 30 < 10 else 1 if i % 30 < 20 else 2) for i in range(240)]
    return spark.createDataFrame(rows, "id int, features array<double>, y int").cache()


@pytest.mark.parametrize(("kind", "params"), [
    ("bagging", {"numTrees": 5}), ("histgbm", {"maxIter": 3}), ("dnn", {"maxIter": 60, "hidden": [8]}),
])
def test_kinds_learn(xy, kind, params):
    model = train.train(kind, xy.where("id < 200"), 3, params, val=xy.where("id >= 200"))
    scored = model.score(xy)
    assert scored.columns == [*xy.columns, "proba", "pred"]
    row = scored.first()
    assert len(row["proba"]) == 3 and sum(row["proba"]) == pytest.approx(1.0)
    metrics, cells = jobs.evaluate(model, xy, [0, 1, 2])
    assert metrics.first()["accuracy"] > 0.6 and cells.agg(F.sum("n")).first()[0] == 240


def test_parameters():
    assert train.load_params('{"maxDepth": 2}', "xgb")["maxDepth"] == 2
    assert train.load_params(None, "bagging")["numTrees"] == 30
    with pytest.raises(ValueError):
        train.train("unknown", None, 2)


def test_ensemble_and_hardening(xy):
    a = train.train("bagging", xy, 3, {"numTrees": 5})
    b = train.train_hardened("gbm", xy, xy.where("y = 2"), 3, params={"maxIter": 2})
    voted = jobs.ensemble([a, b], xy, 3, ["id"], prefer="gbm")
    assert voted.count() == 240
    joined = voted.join(xy, "id")
    assert score.classification_metrics(joined).first()["accuracy"] > 0.9
