import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.functions import inverse_normal
from flowkit.operators import encode
from flowkit.operators.report import continuous_stats, global_clip
from flowkit.sources import tables
from flowkit.spec import DatasetSpec

SPEC = DatasetSpec(
    name="t", features=("port", "kind", "flag", "x", "flat"), cat=("port", "kind"), binary=("flag",),
    onehot=("kind",), scaled_cat=("port",), port="port", majority=("a",), minority=("b",),
)


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(1)
    data = [
        (i, int(rng.integers(1, 65536)), str(rng.choice(["tcp", "udp"])), int(i % 2), float(rng.exponential(3)), 5.0, "ab"[i % 2])
        for i in range(300)
    ]
    return spark.createDataFrame(data, "id int, port int, kind string, flag int, x double, flat double, Label string")


def close(a, b, names, tol=1e-6):
    left = {r["id"]: r for r in a.collect()}
    for r in b.collect():
        for n in names:
            assert left[r["id"]][n] == pytest.approx(r[n], abs=tol), n


def test_scalers_invert(rows):
    params = encode.fit_numeric(rows, ["x", "flat"])
    scaled = encode.minmax(rows, params)
    span = scaled.agg(F.min("x"), F.max("x"), F.max("flat")).first()
    assert tuple(span) == (0.0, 1.0, 0.0)  # a constant column maps to 0
    close(rows, encode.minmax(scaled, params, inverse=True), ["x", "flat"])
    normal = encode.standardize(rows, params)
    assert normal.agg(F.avg("x"), F.stddev_pop("x")).first()[1] == pytest.approx(1.0)
    close(rows, encode.standardize(normal, params, inverse=True), ["x", "flat"])


def test_quantiles_invert(rows):
    params = encode.fit_quantiles(rows, ["x", "flat"], ["id"], 50)
    uniform = encode.quantile_uniform(rows, params)
    values = [r["x"] for r in uniform.collect()]
    assert min(values) == 0.0 and max(values) == 1.0
    assert {r["flat"] for r in uniform.collect()} == {0.0}
    close(rows, encode.quantile_uniform(uniform, params, inverse=True), ["x", "flat"])
    normal = encode.quantile_normal(rows, params)
    close(rows, encode.quantile_normal(normal, params, inverse=True), ["x"], 1e-4)


def test_quantile_ties_map_to_the_middle(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 1, 1, 2])], "id int, x double")
    out = encode.quantile_uniform(df, encode.fit_quantiles(df, ["x"], ["id"], 5))
    assert [round(r["x"], 6) for r in out.orderBy("id").collect()] == [0.0, 0.5, 0.5, 0.5, 1.0]


def test_inverse_normal(spark):
    ps = [1e-7, 1e-3, 0.02425, 0.1, 0.5, 0.7, 0.99, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(inverse_normal(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-7)


def test_onehot(rows):
    cats = encode.fit_categories(rows, ["kind"])
    hot = encode.onehot(rows, cats)
    assert hot.columns[:2] == ["kind_tcp", "kind_udp"] and "kind" not in hot.columns
    back = encode.onehot_inverse(hot, cats)
    assert back.join(rows, ["id", "kind"]).count() == 300
    unknown = encode.onehot(rows.withColumn("kind", F.lit("icmp")), cats)
    assert encode.onehot_inverse(unknown, cats).where("kind is null").count() == 300


def test_unknown_values_fail(rows):
    cats = encode.fit_categories(rows, ["kind"])
    odd = rows.withColumn("kind", F.lit("icmp"))
    with pytest.raises(Exception, match="unknown category"):
        encode.ordinal(odd, cats, ["kind"]).collect()
    assert encode.ordinal(odd, cats, ["kind"], unknown=-1).first()["kind"] == -1
    with pytest.raises(Exception, match="unknown label"):
        encode.label_encode(rows.withColumn("Label", F.lit("zz")), encode.fit_labels(rows)).collect()


def test_ports(spark):
    df = spark.createDataFrame([(0,), (1,), (65535,), (70000,)], "port int")
    codes = [r["port"] for r in encode.ordinal_port(df, "port").collect()]
    assert codes == [-1, 0, 65534, -1]


@pytest.mark.parametrize("kind", ["minmax", "quantile_uniform"])
def test_whole_inverse(rows, kind):
    enc = encode.fit_encoders(rows, SPEC, ["id"], 300)
    there = encode.encode_minority(rows, enc, SPEC, kind)
    back = encode.inverse_transform(there, enc, SPEC, kind)
    assert back.columns == [*SPEC.features, "Label"]
    key = lambda df: sorted((r["port"], r["kind"], r["flag"], round(r["x"], 5), r["Label"]) for r in df.collect())
    assert key(back) == key(rows)


def test_encode_majority_keeps_first_of_equal_rows(rows):
    twice = rows.drop("id").withColumn("__rowid__", F.lit(1)).unionByName(rows.drop("id").withColumn("__rowid__", F.lit(0)))
    out = encode.encode_majority(twice, encode.fit_encoders(rows, SPEC), SPEC)
    assert out.count() == 300 and {r["__rowid__"] for r in out.collect()} == {0}


def test_no_quantiles_is_an_error(rows):
    enc = encode.fit_encoders(rows, SPEC)
    with pytest.raises(ValueError):
        encode.encode_minority(rows, enc, SPEC, "quantile_uniform")


def test_decoding_cleans_up(spark):
    df = spark.createDataFrame([(1e-12,), (-3.0,), (1.123456789,)], "x double")
    assert [r["x"] for r in encode.clean_decoded(df, ["x"]).collect()] == [0.0, 0.0, 1.12345679]


def test_prepare(rows):
    enc = encode.fit_encoders(rows, SPEC)
    prep = encode.prepare_training(rows, enc, SPEC)
    assert {r["subset"]: r["count"] for r in prep.rows.groupBy("subset").count().collect()} == {"val": 30, "train": 270}
    stats = {r["column"]: r for r in prep.stats.collect()}
    assert stats["flat"]["std"] == 1.0
    given = encode.prepare_input(rows, enc, SPEC)
    assert given.rows.count() == 300 and given.clip.first()["clip_min"] == 0.0


def test_squeeze_levels(rows):
    clip = global_clip(rows, ["x"])
    out = encode.squeeze_features(rows, ["x"], 2, clip)
    assert out.select(F.round("x", 9)).distinct().count() <= 4
    lo, hi = clip.first()
    assert math.isclose(out.agg(F.max("x")).first()[0], hi) and math.isclose(out.agg(F.min("x")).first()[0], lo)


def test_input_norm(rows):
    out = encode.input_norm(rows, continuous_stats(rows, ["x", "flat"]))
    assert out.agg(F.avg("x")).first()[0] == pytest.approx(0.0, abs=1e-9)
    assert out.agg(F.max("flat")).first()[0] == 0.0


def test_params_round_trip(spark, rows, tmp_path):
    enc = encode.fit_encoders(rows, SPEC)
    tables.save_params(enc.tables(), str(tmp_path))
    back = tables.load_params(spark, str(tmp_path), ["numeric", "labels", "categories"])
    assert back["labels"].orderBy("code").collect() == enc.labels.orderBy("code").collect()
    assert tables.load_params(spark, str(tmp_path), ["absent"]) is None


def test_quantiles_use_every_row(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.exponential(size=3000), 2)
    rows = spark.createDataFrame([(i, float(v), None) for i, v in enumerate(x)], "id int, x double, none double")
    got = {r["column"]: r["quantiles"] for r in encode.fit_quantiles(rows, ["x", "none"], ["id"], 257).collect()}
    assert list(got) == ["x"]
    assert got["x"] == pytest.approx(np.quantile(x, np.linspace(0, 1, 257)).tolist())
    one = spark.createDataFrame([(1, 2.5)], "id int, x double")
    assert encode.fit_quantiles(one, ["x"], ["id"], 3).first()["quantiles"] == [2.5, 2.5, 2.5]


def test_scalers_of_a_column_without_values(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    params = encode.fit_numeric(rows, ["x"])
    assert [r.x for r in encode.minmax(rows, params).collect()] == [None, None]
    assert [r.x for r in encode.standardize(rows, params).collect()] == [None, None]
