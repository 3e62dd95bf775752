"""Queries for projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkit.catalog.registry import query
from flowkit.catalog.standins import (
    DIRTY, DIRTY_SPEC, FLOW_SPEC, FLOWS, IDS, MERGED, SKEWED, SOURCES, TYPED, TYPED_BAD,
    TYPED_NEGATIVE, dirty, flows, skewed, sources, sql_hash, table,
)
from flowkit.functions import safe_label
from flowkit.operators import clean, dedup


def _text(*names: str):
    return [F.coalesce(F.col(n).cast("string"), F.lit("?")).alias(n) for n in names]


def _sql_text(*names: str) -> str:
    return ", ".join(f"coalesce(CAST({n} AS VARCHAR), '?') AS {n}" for n in names)


@query("p1_select_features", f"""WITH {DIRTY}
SELECT {_sql_text('port', 'flag', 'value', 'spare', '"Label"')} FROM dirty""")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return clean.select_features(dirty(spark, d), DIRTY_SPEC).select(
        *_text("port", "flag", "value", "spare", "Label")
    )


@query("p2_coerce_types", f"""WITH {TYPED}
SELECT event_id, coalesce(port, -99) AS port, coalesce(flag, -99) AS flag,
  CASE WHEN value IS NULL THEN -99.0::DOUBLE WHEN isinf(value) THEN sign(value) * 88.0::DOUBLE
       ELSE round(value::DOUBLE, 4) END + 0.0 AS value,
  round(spare::DOUBLE, 4) AS spare FROM typed""")
def p2(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value").cast("double")
    return clean.coerce_types(dirty(spark, d), DIRTY_SPEC).select(
        "event_id", F.coalesce("port", F.lit(-99)).alias("port"),
        F.coalesce("flag", F.lit(-99)).alias("flag"),
        (F.when(v.isNull(), -99.0).when(F.abs(v) == float("inf"), F.signum(v) * 88.0)
         .otherwise(F.round(v, 4)) + 0.0).alias("value"),
        F.round(F.col("spare").cast("double"), 4).alias("spare"),
    )


@query("p3_strip_label", f"""WITH {DIRTY}
SELECT event_id, coalesce(trim("Label"), '?') AS "Label" FROM dirty""")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return clean.strip_label(dirty(spark, d)).select("event_id", *_text("Label"))


@query("p4_align_schema", f"""WITH {FLOWS}
SELECT "Label", l_orderkey, 0.0::DOUBLE AS absent, CAST(flag AS VARCHAR) AS flag FROM flows""")
def p4(spark: SparkSession, d: str) -> DataFrame:
    fields = T.StructType([
        T.StructField("Label", T.StringType()), T.StructField("absent", T.DoubleType()),
        T.StructField("l_orderkey", T.LongType()), T.StructField("flag", T.StringType()),
    ])
    return clean.align_schema(flows(spark, d), fields).na.fill(0.0, ["absent"])


TYPES = {"cheap": ["ECONOMY", "SMALL"], "fine": ["STANDARD", "PROMO"], "odd": ["no such type"]}


@query("p5_map_label", """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'cheap'
  WHEN p_type IN ('STANDARD', 'PROMO') THEN 'fine' ELSE 'Benign' END AS "Label" FROM part""")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return clean.map_label(table(spark, d, "part"), "p_type", TYPES, "Benign").select(
        "p_partkey", "Label"
    )


@query("p5_unmapped_names", """SELECT p_type, count(*) AS rows FROM part
WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'STANDARD', 'PROMO') GROUP BY p_type""")
def p5_strict(spark: SparkSession, d: str) -> DataFrame:
    return clean.unmapped_names(table(spark, d, "part"), "p_type", TYPES)


@query("p6_safe_label", """SELECT p_name || '/' || upper(p_type) AS name, count(*) AS n,
  replace(replace(lower(p_name || '/' || p_type), ' ', '_'), '/', '_') AS safe
FROM part GROUP BY ALL""")
def p6(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("/"), F.upper("p_type"))
    return table(spark, d, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(
        "name", "n", safe_label(F.col("name")).alias("safe")
    )


@query("p7_tag", f"""WITH {FLOWS}
SELECT l_orderkey, 'minor:' || "Label" || ':wgan' AS __source__, 'train' AS __subset__ FROM flows""")
def p7(spark: SparkSession, d: str) -> DataFrame:
    tagged = clean.tag(flows(spark, d), "__source__", "minor", F.col("Label"), "wgan")
    return clean.tag(tagged, "__subset__", "train").select("l_orderkey", "__source__", "__subset__")


@query("p8_add_row_id", f"""WITH {FLOWS}
SELECT {', '.join(IDS)}, "Label",
  row_number() OVER (PARTITION BY "Label" ORDER BY {sql_hash(0, IDS)}) - 1 AS __rowid__ FROM flows""")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return clean.add_row_id(flows(spark, d).select(*IDS, "Label"), "Label", IDS)


@query("p9_drop_tech_cols", f"""WITH {FLOWS}
SELECT l_orderkey, l_linenumber, "Label" FROM flows""")
def p9(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).select("l_orderkey", "l_linenumber", "Label")
    rows = clean.with_row_key(clean.tag(rows, "__subset__", "train"), ["l_orderkey"])
    return clean.drop_tech_cols(rows)


@query("p10_detect_label_column", f"""WITH {SOURCES}
SELECT "Label" AS found, count(*) AS rows FROM sources GROUP BY 1""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    rows = sources(spark, d)
    name = clean.detect_label_column(rows.columns, preferred="no such column")
    return rows.groupBy(F.col(name).alias("found")).agg(F.count("*").alias("rows"))


@query("p11_reorder", f"""WITH {FLOWS}
SELECT port, flag, quantity, price, discount, tax, "Label" FROM flows""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return clean.reorder(flows(spark, d), FLOW_SPEC)


@query("p12_feature_matrix", f"""WITH {FLOWS}
SELECT {', '.join(IDS)}, port::DOUBLE AS x0, flag::DOUBLE AS x1, quantity AS x2, price AS x3,
  discount AS x4, tax AS x5 FROM flows""")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return clean.feature_matrix(flows(spark, d), FLOW_SPEC).select(
        *IDS, *[F.col("features")[i].alias(f"x{i}") for i in range(6)]
    )


@query("p13_relabel_selected", f"""WITH {MERGED}
SELECT f1, f2, 'click' AS __attack__ FROM merged
WHERE list_contains(string_split(__attack__, '|'), 'click')""")
def p13(spark: SparkSession, d: str) -> DataFrame:
    merged = dedup.merge_sources(sources(spark, d), ["f1", "f2"], ["event_id"])
    return clean.relabel_selected(clean.rows_of_source(merged, "click"), "click").select(
        "f1", "f2", "__attack__"
    )


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return clean.strip_label(clean.coerce_types(dirty(spark, d).drop("props"), DIRTY_SPEC))


@query("f1_drop_missing_inf", f"""WITH {TYPED}
SELECT event_id, port, flag, round(value::DOUBLE, 4) + 0.0 AS value, "Label" FROM typed WHERE NOT {TYPED_BAD}""")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_missing_inf(_typed(spark, d)).select(
        "event_id", "port", "flag",
        (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"), "Label",
    )


@query("f2_has_missing_inf", f"""WITH {TYPED}
SELECT 'before' AS stage, bool_or({TYPED_BAD}) AS has_missing_inf FROM typed
UNION ALL SELECT 'after', coalesce(bool_or({TYPED_BAD}), false) FROM typed WHERE NOT {TYPED_BAD}""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    rows = _typed(spark, d)
    before, after = clean.has_missing_inf(rows), clean.has_missing_inf(clean.drop_missing_inf(rows))
    return before.withColumn("stage", F.lit("before")).unionByName(
        after.withColumn("stage", F.lit("after"))
    )


@query("f3_drop_negative_rows", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer "
       "WHERE c_custkey >= 0 AND c_nationkey >= 0 AND c_acctbal >= 0")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_negative_rows(table(spark, d, "customer")).select(
        "c_custkey", "c_nationkey", "c_acctbal"
    )


@query("f3_drop_negative_typed", f"""WITH {TYPED}
SELECT event_id FROM typed WHERE coalesce(port >= 0 AND flag >= 0 AND value >= 0 AND spare >= 0, false)""")
def f3_typed(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_negative_rows(_typed(spark, d)).select("event_id")


@query("f4_drop_zero_heavy", f"""WITH {FLOWS}
SELECT {', '.join(IDS)} FROM flows
WHERE (port = 0)::INT + (flag = 0)::INT + (discount = 0)::INT + (tax = 0)::INT < 2""")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_zero_heavy(flows(spark, d), ["port", "flag", "discount", "tax"]).select(*IDS)


@query("f5_resolve_labels", f"""WITH {SKEWED}
SELECT event_id, "Label" FROM skewed WHERE "Label" IN ('rare', 'click')""")
def f5(spark: SparkSession, d: str) -> DataFrame:
    known = ["bulk", "tenth", "rare", "click", "view"]
    return clean.filter_labels(
        skewed(spark, d), "Label", known, ["rare", "click", "bulk"], ["bulk"]
    ).select("event_id", "Label")


@query("f6_filter_label_files", f"""WITH {FLOWS}
SELECT lower("Label") AS label_safe, count(*) AS rows FROM flows
WHERE "Label" IN ('AF', 'AO', 'NF', 'RO') GROUP BY 1""")
def f6(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).withColumn("label_safe", safe_label(F.col("Label")))
    known = ["af", "ao", "nf", "no", "ro"]
    return clean.filter_labels(rows, "label_safe", known, exclude=["no"]).groupBy("label_safe").agg(
        F.count("*").alias("rows")
    )


@query("f7_rows_of_source", f"""WITH {MERGED},
used AS (SELECT f1, f2 FROM merged WHERE list_contains(string_split(__attack__, '|'), 'view'))
SELECT f1, f2, "Label", __attack__ FROM merged m
WHERE list_contains(string_split(__attack__, '|'), 'click')
  AND NOT EXISTS (SELECT 1 FROM used u WHERE u.f1 = m.f1 AND u.f2 = m.f2)""")
def f7(spark: SparkSession, d: str) -> DataFrame:
    merged = clean.with_row_key(
        dedup.merge_sources(sources(spark, d), ["f1", "f2"], ["event_id"]), ["f1", "f2"]
    )
    return clean.rows_of_source(merged, "click", clean.rows_of_source(merged, "view")).drop("_key_")


@query("f8_filter_sources", f"""WITH {SOURCES}
SELECT event_id, __attack__ FROM sources WHERE __attack__ IN ('click', 'error')""")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return clean.filter_sources(sources(spark, d), ["click", "error"]).select("event_id", "__attack__")


@query("f9_require_columns", f"""WITH {FLOWS}
SELECT "Label", count(*) AS rows FROM flows GROUP BY 1""")
def f9(spark: SparkSession, d: str) -> DataFrame:
    tables = [flows(spark, d), table(spark, d, "orders")]
    fit = [t for t in tables if clean.require_columns(t, ["price", "Label"]) is not None]
    return fit[0].groupBy("Label").agg(F.count("*").alias("rows"))


@query("f10_exclude_models", """WITH p AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'gbm' WHEN 'view' THEN 'histgbm'
    WHEN 'error' THEN 'xgb' ELSE 'dnn' END AS model FROM events)
SELECT event_id, model FROM p WHERE model IN ('histgbm', 'xgb')""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    model = F.when(kind == "click", "gbm").when(kind == "view", "histgbm").when(
        kind == "error", "xgb"
    ).otherwise("dnn")
    probs = table(spark, d, "events").select("event_id", model.alias("model"))
    return clean.exclude_models(probs, exclude=["dnn"])


@query("a6_cleaning_report", f"""WITH {TYPED}, fate AS (
  SELECT *, CASE WHEN coalesce("Label" = 'Label', false) THEN 'header' WHEN {TYPED_BAD} THEN 'bad'
                 WHEN {TYPED_NEGATIVE} THEN 'negative' ELSE 'kept' END AS fate FROM typed),
kept AS (SELECT DISTINCT port, flag, value, spare, "Label" FROM fate WHERE fate = 'kept')
SELECT count(*) AS rows_read, count_if(fate = 'header')::BIGINT AS header_rows,
  count_if(fate = 'bad')::BIGINT AS bad_rows, count_if(fate = 'negative')::BIGINT AS negative_rows,
  count_if(fate = 'kept')::BIGINT - (SELECT count(*) FROM kept) AS duplicate_rows,
  (SELECT count(DISTINCT "Label") FROM kept) AS labels, (SELECT count(*) FROM kept) AS rows_left
FROM fate""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return clean.cleaning_report(dirty(spark, d), DIRTY_SPEC)
