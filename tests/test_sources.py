import pytest
from pyspark.sql import functions as F

from flowkit.plans import jobs
from flowkit.sources import tables
from flowkit.spec import NSLKDD, DatasetSpec

SPEC = DatasetSpec(name="t", features=("Dst Port", "Flow Byts/s"), cat=("Dst Port",))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text("Dst Port, Flow Byts/s ,Label\n80, 1.5,Bot\n80,1.5,Bot\nDst Port,Flow Byts/s,Label\n")
    (tmp_path / "b.CSV").write_text("Dst Port,Flow Byts/s,Label\n443,Infinity,Bot\n22,2.5, SSH-Bruteforce \n")
    (tmp_path / "c.csv").write_text("Flow ID,Label,Dst Port,Flow Byts/s\nx,Bot,81,3.5\n")
    (tmp_path / "d.csv").write_text("Dst Port,Label\n1,Bot\n")
    (tmp_path / "notes.txt").write_text("no data")
    return str(tmp_path)


def test_listing(spark, folder, tmp_path):
    files = tables.list_inputs(spark, folder)
    assert [r["path"].rsplit("/", 1)[1] for r in files.orderBy("file_order").collect()] == ["a.csv", "b.CSV", "c.csv", "d.csv"]
    with pytest.raises(FileNotFoundError):
        tables.list_inputs(spark, folder, ".parquet")


def test_vote_and_drift(spark, folder):
    headers = tables.read_header(spark, tables.list_inputs(spark, folder))
    voted = tables.majority_schema(headers)
    assert voted.first()["header"] == ["Dst Port", "Flow Byts/s", "Label"] and voted.first()["files"] == 2
    drift = {r["file_order"]: r for r in tables.schema_drift(headers, voted).collect()}
    assert drift[3]["extra"] == ["Flow ID"] and drift[3]["n_missing"] == 0
    assert drift[4]["missing"] == ["Flow Byts/s"]


def test_columns_follow_their_names(spark, folder):
    headers = tables.read_header(spark, tables.list_inputs(spark, folder))
    rows = tables.read_flows(spark, headers, ["Dst Port", "Flow Byts/s", "Label"])
    by_file = {}
    for r in rows.collect():
        by_file.setdefault(r["__file__"], []).append(tuple(r)[:3])
    assert by_file["c.csv"] == [("81", "3.5", "Bot")]
    assert by_file["d.csv"] == [("1", None, "Bot")]
    assert by_file["a.csv"][0] == ("80", "1.5", "Bot")


def test_clean_flows(spark, folder, tmp_path):
    done = jobs.clean_flows(spark, folder, SPEC, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in done.rows.collect()) == [
        (22, 2.5, "SSH-Bruteforce"), (80, 1.5, "Bot"), (81, 3.5, "Bot"),
    ]
    report = done.report.first()
    assert report["rows_read"] == 7 and report["header_rows"] == 1 and report["duplicate_rows"] == 1
    assert (tmp_path / "out" / "label_safe=ssh-bruteforce").is_dir()


def test_headerless(spark, tmp_path):
    path = tmp_path / "kdd.txt"
    numbers = ",".join("0" for _ in range(37))
    lines = []
    for i in range(40):
        attack = ["normal", "smurf", "nmap", "perl"][i % 4]
        lines.append(f"{i},tcp,http,SF,{numbers},{attack},21")
    path.write_text("\n".join(lines))
    parts, cards, enc = jobs.clean_headerless(spark, str(path), NSLKDD)
    assert {(r["Label"], r["subset"]): r["count"] for r in parts.groupBy("Label", "subset").count().collect()} == {
        (x, s): n for x in ("Benign", "DoS", "Probe", "U2R") for s, n in (("test", 3), ("train", 7))
    }
    assert {r["column"]: r["cardinality"] for r in cards.collect()} == {"protocol_type": 1, "service": 1, "flag": 1}
    assert enc.labels.count() == 4


def test_write_read_subset(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, ["DoS Hulk", "a/b"][i % 2], ["train", "test"][i % 3 == 0]) for i in range(30)], "id int, Label string, subset string"
    )
    out = str(tmp_path / "t")
    tables.write_by_label(rows, out, extra=("subset",))
    got = tables.read_subset(spark, out, "test", ["DoS Hulk"])
    assert sorted(r["id"] for r in got.collect()) == [0, 6, 12, 18, 24]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subset" in plan


def test_prefer_variant(spark):
    rows = spark.createDataFrame(
        [("a", "full", 1), ("a", "compressed", 2), ("b", "full", 3), ("c", "draft", 4)], "Label string, variant string, id int"
    )
    assert sorted(r["id"] for r in tables.read_preferring(rows).collect()) == [2, 3]


def test_source_discovery(spark):
    files = spark.createDataFrame(
        [("xgb", "fgsm", "x1"), ("dnn", "fgsm", "d1"), ("dnn", "cw", "d2"), ("gbm", "pgd", "g1")],
        "model string, attack string, path string",
    )
    assert {(r["attack"], r["path"]) for r in tables.discover_sources(files, "xgb").collect()} == {("fgsm", "x1"), ("cw", "d2")}
    assert tables.discover_sources(files, "xgb", attacks=["cw"]).count() == 1
    assert [r["attack"] for r in tables.require_all_sources(files, ["xgb", "dnn"]).collect()] == ["fgsm"]


def test_source_names(spark):
    df = spark.createDataFrame([("/d/cic2018_xgb_fgsm_v2_adv.csv",), ("other.v1.csv",), ("cic2018_dnn_cw_adv.csv",)], "f string")
    got = [r[0] for r in df.select(tables.parse_source_name(F.col("f"), "cic2018", "xgb")).collect()]
    assert got == ["fgsm_v2", "other.v1", "cic2018_dnn_cw_adv"]


def test_model_variants(spark):
    df = spark.createDataFrame(
        [("m", "base", "p0"), ("m", "robust", "p1"), ("n", "base", "p2"), ("o", "draft", "p3")], "model string, variant string, path string"
    )
    assert {r["model"]: r["path"] for r in tables.pick_model_variant(df).collect()} == {"m": "p1", "n": "p2"}


def test_metrics_as_json(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    tables.write_metrics(df, str(tmp_path / "all"))
    tables.write_metrics(df, str(tmp_path / "each"), per="model")
    assert spark.read.json(str(tmp_path / "all")).first()["accuracy"] == 0.5
    assert (tmp_path / "each" / "model=m").is_dir()


def test_header_with_quoted_commas(spark):
    line = spark.createDataFrame([('"a,1", b ,"say ""x""",Label',)], "line string")
    from flowkit.sources.tables import header_names

    assert line.select(header_names(line.line)).first()[0] == ["a,1", "b", 'say "x"', "Label"]
