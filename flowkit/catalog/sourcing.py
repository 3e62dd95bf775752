"""Queries for sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.registry import query
from flowkit.catalog.standins import (
    DIRTY, FLOWS, IDS, SKEWED, dirty, flows, skewed, table,
)
from flowkit.operators import report
from flowkit.sources import tables
from flowkit.staging import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _csv_export(spark: SparkSession, d: str) -> str:
    """Events as CSV files; a third of the rows has an extra column in front, in its own files."""
    folder = _folder(spark, "csv")
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("Label"))
    most, some = e.where("event_id % 3 > 0"), e.where("event_id % 3 = 0")
    most.repartition(4).write.csv(folder, header=True)
    some.select(F.lit("x").alias("Flow ID"), "*").repartition(2).write.mode("append").csv(
        folder, header=True
    )
    return folder


@query("s1_list_inputs")
def s1(spark: SparkSession, d: str) -> DataFrame:
    files = tables.list_inputs(spark, _csv_export(spark, d))
    return files.select("file_order", F.lower(F.substring_index("path", ".", -1)).alias("ext"))


@query("s2_read_header")
def s2(spark: SparkSession, d: str) -> DataFrame:
    headers = tables.read_header(spark, tables.list_inputs(spark, _csv_export(spark, d)))
    return headers.select("file_order", F.array_join("header", "|").alias("header"))


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a file whose header line is its name."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("file_order"), F.split("p_name", " ").alias("header")
    )


VOTE = """vote AS (
  SELECT p_name, count(*) AS files, min(p_partkey) AS first FROM part GROUP BY p_name
  ORDER BY files DESC, first LIMIT 1)"""


@query("s3_majority_schema", f"""WITH {VOTE}
SELECT replace(p_name, ' ', '|') AS header, files, first FROM vote""")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return tables.majority_schema(_headers(spark, d)).select(
        F.array_join("header", "|").alias("header"), "files", "first"
    )


@query("s4_schema_drift", f"""WITH {VOTE}, h AS (
  SELECT p_partkey, string_split(p.p_name, ' ') AS h, string_split(v.p_name, ' ') AS m
  FROM part p, vote v WHERE p.p_name <> v.p_name), x AS (
  SELECT p_partkey, [a FOR a IN h IF NOT list_contains(m, a)] AS extra,
         [a FOR a IN m IF NOT list_contains(h, a)] AS missing FROM h)
SELECT p_partkey AS file_order, array_to_string(extra, '|') AS extra,
       array_to_string(missing, '|') AS missing, CAST(len(extra) AS INTEGER) AS n_extra,
       CAST(len(missing) AS INTEGER) AS n_missing FROM x""")
def s4(spark: SparkSession, d: str) -> DataFrame:
    headers = _headers(spark, d)
    drift = tables.schema_drift(headers, tables.majority_schema(headers))
    return drift.withColumn("extra", F.array_join("extra", "|")).withColumn(
        "missing", F.array_join("missing", "|")
    )


@query("s5_read_flows", """SELECT CAST(event_id AS VARCHAR) AS event_id,
  CAST(user_id AS VARCHAR) AS user_id, event_type AS "Label" FROM events""")
def s5(spark: SparkSession, d: str) -> DataFrame:
    headers = tables.read_header(spark, tables.list_inputs(spark, _csv_export(spark, d)))
    voted = tables.majority_schema(headers).first()["header"]
    return tables.read_flows(spark, headers, voted).drop("__file__")


@query("s6_read_headerless", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_acctbal
FROM customer""")
def s6(spark: SparkSession, d: str) -> DataFrame:
    folder, names = _folder(spark, "text"), ("c_custkey", "c_name", "c_acctbal")
    table(spark, d, "customer").select(*names).write.csv(folder, header=False)
    return tables.read_headerless(spark, folder, names, numeric=("c_acctbal",))


@query("s7_drop_repeated_headers", f"""WITH {DIRTY}
SELECT event_id, coalesce("Label", '?') AS "Label" FROM dirty
WHERE coalesce(trim("Label") <> 'Label', true)""")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return tables.drop_repeated_headers(dirty(spark, d)).select(
        "event_id", F.coalesce("Label", F.lit("?")).alias("Label")
    )


@query("s8_write_by_label", f"""WITH {SKEWED}
SELECT event_id, "Label", replace(replace(lower("Label"), ' ', '_'), '/', '_') AS label_safe
FROM skewed""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "by-label")
    tables.write_by_label(skewed(spark, d), path)
    return spark.read.parquet(path).select("event_id", "Label", "label_safe")


@query("s9_split_to_label_tables", f"""WITH {FLOWS}
SELECT lower("Label") AS label_safe, count(*) AS rows, sum(l_orderkey)::BIGINT AS orders
FROM flows WHERE "Label" IN ('AF', 'NO', 'RO') GROUP BY 1""")
def s9(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.split_to_label_tables(flows(spark, d), ["AF", "NO", "RO"])
    return rows.groupBy("label_safe").agg(
        F.count("*").alias("rows"), F.sum("l_orderkey").alias("orders")
    )


@query("s10_read_subset", """SELECT event_id, event_type AS "Label" FROM events
WHERE event_id % 3 = 0 AND event_type IN ('click', 'view') AND user_id % 2 = 0""")
def s10(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "subsets")
    rows = table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("Label"),
        F.when(F.col("event_id") % 3 == 0, "test").otherwise("train").alias("subset"),
        F.when(F.col("user_id") % 2 == 0, "full").otherwise("compressed").alias("variant"),
    )
    tables.write_by_label(rows, path, extra=("subset", "variant"))
    return tables.read_subset(spark, path, "test", ["Click", "view"], "full").select(
        "event_id", "Label"
    )


@query("s11_read_preferring", """WITH v AS (
  SELECT event_id, event_type AS "Label",
         CASE WHEN event_type IN ('click', 'error') AND event_id % 4 = 0 THEN 'compressed'
              WHEN event_id % 4 = 1 THEN 'other' ELSE 'full' END AS variant FROM events),
r AS (SELECT *, CASE variant WHEN 'compressed' THEN 0 WHEN 'full' THEN 1 END AS r FROM v),
b AS (SELECT "Label", min(r) AS b FROM r WHERE r IS NOT NULL GROUP BY "Label")
SELECT event_id, r."Label" AS "Label", variant FROM r JOIN b ON r."Label" = b."Label" AND r.r = b.b""")
def s11(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id") % 4
    rows = table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("Label"),
        F.when(F.col("event_type").isin("click", "error") & (e == 0), "compressed")
        .when(e == 1, "other").otherwise("full").alias("variant"),
    )
    return tables.read_preferring(rows)


MODEL = "CASE CAST(user_id % 6 AS INTEGER) WHEN 0 THEN 'xgb' WHEN 1 THEN 'dnn' WHEN 2 THEN 'xgb' WHEN 3 THEN 'dnn' ELSE 'gbm' END"
MODEL_FILES = f"""files AS (
  SELECT DISTINCT {MODEL} AS model, event_type || '_' || CAST(user_id // 3 AS VARCHAR) AS attack,
         'cic2018_' || {MODEL} || '_' || event_type || '_' || CAST(user_id // 3 AS VARCHAR) || '_adv.csv' AS path
  FROM events)"""


def _model_files(spark: SparkSession, d: str) -> DataFrame:
    """One file per (model, attack) that occurs in the events; no attack has all models."""
    attack = F.concat_ws("_", "event_type", F.floor(F.col("user_id") / 3).cast("string"))
    return table(spark, d, "events").select(
        F.expr(MODEL).alias("model"), attack.alias("attack")
    ).distinct().withColumn(
        "path", F.concat(F.lit("cic2018_"), "model", F.lit("_"), "attack", F.lit("_adv.csv"))
    )


@query("s12_discover_sources", f"""WITH {MODEL_FILES},
own AS (SELECT attack, min(path) AS own FROM files WHERE model = 'xgb' GROUP BY attack),
other AS (SELECT attack, min(path) AS other FROM files WHERE model = 'dnn' GROUP BY attack)
SELECT attack, coalesce(own, other) AS path FROM own FULL OUTER JOIN other USING (attack)""")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return tables.discover_sources(_model_files(spark, d), "xgb")


@query("s13_parse_source_name", f"""WITH {MODEL_FILES}
SELECT path, CASE WHEN starts_with(path, 'cic2018_xgb_')
  THEN substr(path, 13, len(path) - 12 - 8) ELSE substr(path, 1, len(path) - 4) END AS attack
FROM files""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return _model_files(spark, d).select(
        "path", tables.parse_source_name(F.col("path"), "cic2018", "xgb").alias("attack")
    )


@query("s14_require_all_sources", f"""WITH {MODEL_FILES}
SELECT attack, count(DISTINCT model) AS models FROM files WHERE model IN ('xgb', 'dnn')
GROUP BY attack HAVING count(DISTINCT model) = 2""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return tables.require_all_sources(_model_files(spark, d), ["xgb", "dnn"])


@query("s15_save_load_params", f"""WITH {FLOWS}
SELECT 'price' AS "column", min(price) AS min, max(price) AS max FROM flows
UNION ALL SELECT 'tax', min(tax), max(tax) FROM flows""")
def s15(spark: SparkSession, d: str) -> DataFrame:
    from flowkit.operators.encode import fit_numeric

    folder = _folder(spark, "params")
    tables.save_params({"numeric": fit_numeric(flows(spark, d), ["price", "tax"])}, folder)
    return tables.load_params(spark, folder, ["numeric"])["numeric"].select("column", "min", "max")


@query("s16_write_metrics", f"""WITH {SKEWED}
SELECT "Label", count(*) AS rows FROM skewed GROUP BY "Label" """)
def s16(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "metrics")
    tables.write_metrics(report.label_distribution(skewed(spark, d)), path, per="Label")
    return spark.read.schema("rows bigint, Label string").json(path)


@query("s17_write_table", f"""WITH {FLOWS}
SELECT {', '.join(IDS)}, "Label" FROM flows""")
def s17(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "table")
    tables.write_table(flows(spark, d).select(*IDS, "Label"), path, order="l_orderkey")
    return spark.read.parquet(path)


VARIANT = """CASE WHEN user_id % 5 = 0 AND event_type = 'error' THEN 'isolated_robust'
  WHEN user_id % 2 = 0 AND event_type = 'click' THEN 'robust'
  WHEN event_type = 'view' THEN 'base' ELSE 'draft' END"""


@query("s18_pick_model_variant", f"""WITH v AS (
  SELECT DISTINCT 'm' || CAST(user_id AS VARCHAR) AS model, {VARIANT} AS variant,
         event_type || '_' || CAST(event_id % 7 AS VARCHAR) AS path FROM events),
r AS (SELECT *, CASE variant WHEN 'isolated_robust' THEN 0 WHEN 'robust' THEN 1 WHEN 'base' THEN 2 END AS r FROM v),
p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY r, variant, path) AS rn FROM r WHERE r IS NOT NULL)
SELECT model, variant, path FROM p WHERE rn = 1""")
def s18(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "events").select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"),
        F.expr(VARIANT).alias("variant"),
        F.concat_ws("_", "event_type", (F.col("event_id") % 7).cast("string")).alias("path"),
    ).distinct()
    return tables.pick_model_variant(paths)
