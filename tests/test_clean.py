import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkit.functions import safe_label, sanitize_port
from flowkit.operators import clean, dedup
from flowkit.spec import CIC2018, NSLKDD, DatasetSpec

SPEC = DatasetSpec(name="t", features=("port", "flag", "x", "gone"), cat=("port",), binary=("flag",))
CELLS = [
    ("80", "1", "1.5", "a"), ("12.0", "0", "2", " a "), ("12.7", "0", "1", "a"),
    ("x", "0", "1", "a"), ("1", "0", "Infinity", "a"), ("1", "0", "-Infinity", "a"),
    ("1", "0", "NaN", "a"), ("1", "0", "-1", "a"), ("1", "0", "-0.0", "b"), ("1", "0", "1", None),
    ("1", "0", "1", "Label"), ("80", "1", "1.5", "a"), (None, "0", "1", "a"), ("1", "0", "1e300", "a"),
]


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(CELLS, "port string, flag string, x string, Label string").withColumn(
        "extra", F.lit("dropped")
    )


def test_published_specs():
    assert len(CIC2018.features) == 62 and len(CIC2018.cont) == 57 and len(CIC2018.drop) == 17
    assert len(NSLKDD.raw_columns) == 43 and len(NSLKDD.features) == 41 and len(NSLKDD.cont) == 34
    assert CIC2018.ordered_features[:2] == ("Dst Port", "RST Flag Cnt")
    assert set(NSLKDD.features) == set(NSLKDD.ordered_features)
    assert CIC2018.accept_rate("Brute Force -XSS") == 0.5 and CIC2018.accept_rate("Bot") == 0.3
    assert NSLKDD.class_names == ("Benign", "DoS", "Probe", "R2L", "U2R")


def test_select_skips_or_fails(dirty):
    assert clean.select_features(dirty, SPEC).columns == ["port", "flag", "x", "Label"]
    strict = DatasetSpec(name="s", features=("gone",), require_all_features=True)
    with pytest.raises(ValueError):
        clean.select_features(dirty, strict)


def test_coerce(dirty):
    rows = clean.coerce_types(clean.select_features(dirty, SPEC), SPEC).collect()
    assert [r["port"] for r in rows[:4]] == [80, 12, None, None]
    assert rows[4]["x"] == math.inf and rows[6]["x"] is None and rows[1]["x"] == 2.0
    assert rows[13]["x"] == math.inf  # beyond the range of a float


def test_text_categories_stay_text(spark):
    df = spark.createDataFrame([("tcp", "1", "2")], "protocol_type string, land string, duration string")
    row = clean.coerce_types(df, NSLKDD).first()
    assert row["protocol_type"] == "tcp" and row["land"] == 1 and row["duration"] == 2.0


def test_clean_rows_and_report_agree(dirty):
    rows = sorted(tuple(r) for r in clean.clean_rows(dirty, SPEC).collect())
    assert rows == [(1, 0, -0.0, "b"), (12, 0, 2.0, "a"), (80, 1, 1.5, "a"), (80, 1, 1.5, "a")]
    report = clean.cleaning_report(dirty, SPEC).first()
    assert report.asDict() == {
        "rows_read": 14, "header_rows": 1, "bad_rows": 8, "negative_rows": 1, "duplicate_rows": 1,
        "labels": 2, "rows_left": 3,
    }


def test_filters_are_idempotent_and_agree_with_the_chain(dirty):
    typed = clean.strip_label(clean.coerce_types(clean.select_features(dirty, SPEC), SPEC))
    once = clean.drop_negative_rows(clean.drop_missing_inf(clean.drop_repeated_headers(typed)))
    again = clean.drop_negative_rows(clean.drop_missing_inf(once))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, clean.clean_rows(dirty, SPEC).collect()))
    assert clean.has_missing_inf(typed).first()[0] is True
    assert clean.has_missing_inf(once).first()[0] is False


def test_negative_filter_without_numbers(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    assert clean.drop_negative_rows(df).count() == 2


def test_nan_is_not_non_negative(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (-1.0,)], "x double")
    assert [r["x"] for r in clean.drop_negative_rows(df).collect()] == [1.0]


def test_zero_heavy(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 1.0), (1.0, 1.0, 1.0)], "a double, b double, c double")
    assert clean.drop_zero_heavy(df, ["a", "b", "c"]).count() == 1  # threshold int(1.5) = 1
    assert clean.drop_zero_heavy(df, ["a", "b", "c"], count=2).count() == 2
    assert clean.drop_zero_heavy(df, ["none"]).count() == 3


def test_label_choice():
    assert clean.resolve_labels(["a", "b", "c"], exclude=["b"]) == ["a", "c"]
    assert clean.resolve_labels(["a", "b", "c"], ["c", "a"]) == ["c", "a"]
    for bad in ({"labels": ["z"]}, {"exclude": ["a", "b", "c"]}):
        with pytest.raises(ValueError):
            clean.resolve_labels(["a", "b", "c"], **bad)


def test_label_detection():
    assert clean.detect_label_column(["f", "y", "Label"]) == "y"
    assert clean.detect_label_column(["f", "y"], preferred="f") == "f"
    assert clean.detect_label_column(["f", "g", "__attack__"]) == "g"
    with pytest.raises(ValueError):
        clean.detect_label_column(["f"], explicit="g")


def test_map_label_default_and_strict(spark):
    df = spark.createDataFrame([("smurf",), ("nmap",), ("loadmodule",), ("normal",)], "attack string")
    got = [r["Label"] for r in clean.map_label(df, "attack", NSLKDD.label_map, "Benign").collect()]
    assert got == ["DoS", "Probe", "Benign", "Benign"]
    strict = clean.unmapped_names(df, "attack", NSLKDD.label_map, known=["normal"]).collect()
    assert [r["attack"] for r in strict] == ["loadmodule"]


def test_source_names_match_whole(spark):
    df = spark.createDataFrame([("pgd",), ("pgd2|cw",), ("cw|pgd",)], "__attack__ string")
    assert clean.rows_of_source(df, "pgd").count() == 2


def test_align_schema(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    fields = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("x", T.LongType())])
    out = clean.align_schema(df, fields)
    assert out.dtypes == [("y", "double"), ("x", "bigint")] and out.first()["y"] is None


def test_ports(spark):
    df = spark.createDataFrame([("0",), ("70000",), (None,), ("80.5",), ("81.5",), ("x",), ("NaN",)], "p string")
    got = [r["p"] for r in df.select(sanitize_port(F.col("p")).alias("p")).collect()]
    assert got == [1, 65535, 1, 80, 82, 1, 1]


def test_safe_label(spark):
    df = spark.createDataFrame([("DoS attacks-Hulk/X",)], "l string")
    assert df.select(safe_label(F.col("l"))).first()[0] == "dos_attacks-hulk_x"


def test_exclude_models(spark):
    df = spark.createDataFrame([("gbm",), ("histgbm",), ("xgb",)], "model string")
    assert {r[0] for r in clean.exclude_models(df).collect()} == {"histgbm", "xgb"}
    assert {r[0] for r in clean.exclude_models(df, ["xgb"], "gbm").collect()} == {"gbm"}


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "Bot")], ["Dst Port", "Flow Byts/s", "Down/Up Ratio", "Label"])
    out = clean.feature_matrix(
        clean.clean_rows(df, CIC2018),
        DatasetSpec(name="n", features=("Dst Port", "Flow Byts/s", "Down/Up Ratio"), cat=("Dst Port",)),
    )
    assert out.first()["features"] == [1.0, 2.0, 3.0]
    assert dedup.dedup_by_features(df, ["Flow Byts/s"], ["Dst Port"]).count() == 1
