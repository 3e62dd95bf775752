"""Queries for de-duplication, set operations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.registry import query
from flowkit.catalog.standins import (
    FEATURES, FLOWS, IDS, JUDGED, MERGED, REPEATED, SOURCES, VECTORS, flows, judged, repeated,
    sources, table, vectors,
)
from flowkit.operators import clean, dedup
from flowkit.operators.nearest import nearest_distance

CONTENT = ["quantity", "discount", "tax", "Label"]
CONTENT_SQL = 'quantity, discount, tax, "Label"'


@query("d1_dedup", f"WITH {REPEATED} SELECT DISTINCT {CONTENT_SQL} FROM repeated")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup(repeated(spark, d).select(*CONTENT))


COUNTED = f"""n AS (SELECT count(*) AS rows FROM repeated),
u AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT {CONTENT_SQL} FROM repeated))"""


@query("d2_count_duplicates", f"""WITH {REPEATED}, {COUNTED}
SELECT rows, distinct_rows, rows - distinct_rows AS duplicates, rows > distinct_rows AS has_duplicates
FROM n, u""")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return dedup.count_duplicates(repeated(spark, d).select(*CONTENT))


@query("d3_dedup_verified", f"""WITH {REPEATED}, {COUNTED}
SELECT rows AS before, rows - distinct_rows AS removed, distinct_rows AS after, 0::BIGINT AS "left"
FROM n, u""")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_verified(repeated(spark, d).select(*CONTENT))[1]


@query("d4_dedup_ignoring", f"""WITH {REPEATED}
SELECT {CONTENT_SQL}, min(__rowid__) AS __rowid__, 'train' AS __subset__ FROM repeated
GROUP BY {CONTENT_SQL}""")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_ignoring(clean.tag(repeated(spark, d), "__subset__", "train"))


@query("d5_dedup_by_features", f"""WITH {SOURCES}
SELECT f1, f2, arg_min("Label", event_id) AS "Label", arg_min(__attack__, event_id) AS __attack__,
  min(event_id) AS event_id FROM sources GROUP BY f1, f2""")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_by_features(sources(spark, d), FEATURES, ["event_id"])


@query("d6_merge_sources", f"""WITH {MERGED} SELECT f1, f2, "Label", __attack__ FROM merged""")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merge_sources(sources(spark, d), FEATURES, ["event_id"])


ORDER_KEYS = ["priority", "year", "bucket"]
ORDERS = """keyed AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority AS priority,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(floor(o_totalprice / 500.0::DOUBLE) AS INTEGER) AS bucket FROM orders)"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("year"),
        F.floor(F.col("o_totalprice") / 500.0).cast("int").alias("bucket"),
    )


@query("d7_exclude_known", f"""WITH {ORDERS}
SELECT o_orderkey, priority, year, bucket FROM keyed k WHERE o_orderstatus = 'O' AND NOT EXISTS (
  SELECT 1 FROM keyed b WHERE b.o_orderstatus = 'F' AND b.priority = k.priority
    AND b.year = k.year AND b.bucket = k.bucket)""")
def d7(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d)
    return dedup.exclude_known(
        rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus = 'F'"), ORDER_KEYS
    ).drop("o_orderstatus", "o_totalprice")


@query("d8_exclude_known_multi", f"""WITH {ORDERS}
SELECT o_orderkey FROM keyed k WHERE o_orderstatus = 'O' AND o_totalprice <= 400000 AND NOT EXISTS (
  SELECT 1 FROM keyed b WHERE (b.o_orderstatus = 'F' OR b.o_orderstatus = 'P' OR b.o_totalprice > 400000)
    AND b.priority = k.priority AND b.year = k.year AND b.bucket = k.bucket)""")
def d8(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d)
    train, test = rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'")
    accepted = rows.where("o_totalprice > 400000")
    return dedup.exclude_known_multi(
        rows.where("o_orderstatus = 'O' AND o_totalprice <= 400000"), [train, test, accepted],
        ORDER_KEYS,
    ).select("o_orderkey")


@query("d9_union_aligned", """SELECT coalesce(c_acctbal, 0.0::DOUBLE) AS bal, coalesce(c_mktsegment, '?') AS seg,
  key, coalesce(n, -1) AS nation FROM (
  SELECT c_custkey AS key, c_acctbal, c_mktsegment, NULL::INTEGER AS n FROM customer
  UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier)""")
def d9(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_acctbal AS bal", "c_mktsegment AS seg")
    b = table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_acctbal AS bal", "s_nationkey AS nation")
    return dedup.union_aligned([a, b]).na.fill(-1, ["nation"]).na.fill("?", ["seg"])


@query("d10_union_train", f"""WITH {FLOWS}
SELECT l_orderkey, price, "Label" FROM flows WHERE "Label" <> 'RO'
UNION ALL SELECT l_orderkey, 0.0::DOUBLE, "Label" FROM flows WHERE "Label" = 'RO'""")
def d10(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).select("l_orderkey", "price", "Label")
    extra = rows.where("Label = 'RO'").select("Label", "l_orderkey", F.lit("x").alias("unknown"))
    return dedup.union_train(rows.where("Label <> 'RO'"), extra).na.fill(0.0, ["price"])


@query("d11_row_key", f"""WITH {REPEATED}
SELECT {CONTENT_SQL}, count(*) AS rows, 1::BIGINT AS keys FROM repeated GROUP BY {CONTENT_SQL}""")
def d11(spark: SparkSession, d: str) -> DataFrame:
    """Equal content gives one key; as many keys as contents."""
    keyed = clean.with_row_key(repeated(spark, d), CONTENT)
    return keyed.groupBy("_key_", *CONTENT).agg(F.count("*").alias("rows")).groupBy(*CONTENT).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("keys")
    )


@query("d12_split_unique_overlap", f"""WITH {MERGED}
SELECT f1, f2, CASE WHEN contains(__attack__, '|') THEN 'overlap' ELSE 'unique' END AS part FROM merged""")
def d12(spark: SparkSession, d: str) -> DataFrame:
    merged = clean.with_row_key(
        dedup.merge_sources(sources(spark, d), FEATURES, ["event_id"]), FEATURES
    )
    unique, overlap = dedup.split_unique_overlap(merged)
    return unique.withColumn("part", F.lit("unique")).unionByName(
        overlap.withColumn("part", F.lit("overlap"))
    ).select("f1", "f2", "part")


@query("d13_select_back", f"""WITH {FLOWS}
SELECT {', '.join(IDS)}, price FROM flows WHERE price > 90000""")
def d13(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    return dedup.select_back(rows, rows.where("price > 90000").select(*IDS), IDS).select(*IDS, "price")


@query("d14_align_by_id", """WITH p AS (SELECT doc_id, quality FROM labels), q AS (
  SELECT doc_id, CAST(n_chars % 2 AS INTEGER) AS pert FROM documents)
SELECT p.doc_id AS sample_id, quality AS y, pert FROM p JOIN q ON p.doc_id = q.doc_id""")
def d14(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "labels").selectExpr("doc_id AS sample_id", "quality AS y")
    pert = table(spark, d, "documents").selectExpr(
        "doc_id AS sample_id", "CAST(n_chars % 2 AS INT) AS pert"
    )
    return dedup.align_by_id(plain, pert)


@query("d14_alignment_counts", f"""WITH {JUDGED}
SELECT (SELECT count(*) FROM labels) AS n_plain, count(DISTINCT sample_id) AS n_perturbed,
  (SELECT count(*) FROM labels) <> count(DISTINCT sample_id) AS differs FROM judged""")
def d14_counts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.alignment_counts(
        table(spark, d, "labels"), judged(spark, d).select("sample_id").distinct()
    )


@query("d15_nearest_distance", f"""WITH {VECTORS}
SELECT a.vec_id, round(min(list_distance(a.features, b.features)), 6) AS dist
FROM vectors a, vectors b WHERE a.cluster <> 0 AND b.cluster = 0 GROUP BY a.vec_id""")
def d15(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    near = nearest_distance(rows.where("cluster <> 0"), rows.where("cluster = 0"), ["vec_id"])
    return near.select("vec_id", F.round("dist", 6).alias("dist"))


@query("d15_nearest_distance_pivots", f"""WITH {VECTORS}
SELECT a.vec_id, round(min(list_distance(a.features, b.features)), 6) AS dist
FROM vectors a, vectors b WHERE a.cluster < 2 AND b.cluster >= 2 GROUP BY a.vec_id""")
def d15_pivots(spark: SparkSession, d: str) -> DataFrame:
    """The way for a right side beyond the broadcast bound."""
    rows = vectors(spark, d)
    near = nearest_distance(
        rows.where("cluster < 2"), rows.where("cluster >= 2"), ["vec_id"], broadcast_values=1
    )
    return near.select("vec_id", F.round("dist", 6).alias("dist"))
