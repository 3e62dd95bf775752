"""Queries for aggregations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.registry import query
from flowkit.catalog.standins import (
    ATTACKS, CLASSES, FEATURES, FLOWS, MERGED, SKEWED, SOURCES, flows, skewed, sources, table,
)
from flowkit.operators import dedup, report


@query("a1_label_distribution", f"""WITH {SKEWED}
SELECT "Label", count(*) AS rows FROM skewed GROUP BY "Label" """)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return report.label_distribution(skewed(spark, d))


@query("a2_table_info", f"""WITH {SKEWED}
SELECT "Label", count(*) AS label_rows, (SELECT count(*) FROM skewed) AS rows, 3::BIGINT AS columns,
  'event_id|user_id|Label' AS names FROM skewed GROUP BY "Label" """)
def a2(spark: SparkSession, d: str) -> DataFrame:
    return report.table_info(skewed(spark, d))


@query("a3_distribution_by_file", """SELECT source AS file, lang AS "Label", count(*) AS rows
FROM documents GROUP BY ALL""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        F.col("source").alias("file"), F.col("lang").alias("Label")
    )
    return report.distribution_by_file(rows, "file")


@query("a4_distinct_values_by_file", """SELECT source AS file,
  string_agg(DISTINCT lang, '|' ORDER BY lang) AS "values" FROM documents GROUP BY source""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("file"), "lang")
    return report.distinct_values_by_file(rows, "file", "lang").withColumn(
        "values", F.array_join("values", "|")
    )


@query("a5_cardinality", """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS cardinality FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return report.cardinality(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


def _cells(names: list[str], column: str, of: str = "count_if({c} = '{n}')") -> str:
    return ", ".join(f"{of.format(c=column, n=n)}::BIGINT AS {n}" for n in names)


@query("a7_crosstab", f"""WITH {SOURCES}
SELECT coalesce(__attack__, 'all') AS __attack__, {_cells(CLASSES, '"Label"')}, count(*) AS total
FROM sources GROUP BY GROUPING SETS ((__attack__), ())""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return report.crosstab(sources(spark, d), "__attack__", "Label", CLASSES)


EXPLODED = MERGED + """, exploded AS (
  SELECT f1, f2, "Label", unnest(string_split(__attack__, '|')) AS a FROM merged)"""


@query("a8_crosstab_exploded", f"""WITH {EXPLODED}
SELECT coalesce(a, 'all') AS __attack__, {_cells(CLASSES, '"Label"')}, count(*) AS total
FROM exploded GROUP BY GROUPING SETS ((a), ())""")
def a8(spark: SparkSession, d: str) -> DataFrame:
    merged = dedup.merge_sources(sources(spark, d), FEATURES, ["event_id"])
    return report.crosstab_exploded(merged, values=CLASSES)


@query("a9_source_overlap", f"""WITH {EXPLODED}
SELECT x.a AS __attack__, {', '.join(f"count_if(y.a = '{n}')::BIGINT AS \"dup-{n}\"" for n in ATTACKS)}
FROM exploded x LEFT JOIN exploded y ON x.f1 = y.f1 AND x.f2 = y.f2 AND x.a <> y.a GROUP BY x.a""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    merged = dedup.merge_sources(sources(spark, d), FEATURES, ["event_id"])
    return report.source_overlap(merged, ATTACKS)


@query("a10_pre_post_counts", f"""WITH {SOURCES}
SELECT __attack__, "Label", count(*) AS before, count(DISTINCT (f1, f2)) AS after
FROM sources GROUP BY __attack__, "Label" """)
def a10(spark: SparkSession, d: str) -> DataFrame:
    return report.pre_post_counts(sources(spark, d), FEATURES)


STAT_COLUMNS = ["quantity", "price", "discount", "tax"]


@query("a11_continuous_stats", f"""WITH {FLOWS} """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean,
    round(CASE WHEN stddev_pop({c}) < 1e-6 THEN 1.0 ELSE stddev_pop({c}) END, 4) AS std FROM flows"""
    for c in STAT_COLUMNS
) + " UNION ALL SELECT 'one', 1.0::DOUBLE, 1.0::DOUBLE")
def a11(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).withColumn("one", F.lit(1.0))
    return report.continuous_stats(rows, [*STAT_COLUMNS, "one"]).select(
        "column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")
    )


@query("a12_global_clip", f"""WITH {FLOWS}
SELECT least(min(quantity), min(price), min(tax)) + 0.0 AS clip_min,
  greatest(max(quantity), max(price), max(tax)) AS clip_max FROM flows""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return report.global_clip(flows(spark, d), ["quantity", "price", "tax"]).withColumn(
        "clip_min", F.col("clip_min") + 0.0
    )


@query("a13_summary_counts", """WITH c AS (
  SELECT p_brand, p_type, count(*) AS rows FROM part GROUP BY p_brand, p_type)
SELECT *, (SELECT greatest(count(*) - 15, 0) FROM c) AS more FROM c ORDER BY p_brand, p_type LIMIT 15""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("rows"))
    return report.summary_counts(counts, ["p_brand", "p_type"])


@query("k15_distance_report", f"""WITH {FLOWS}
SELECT min(price) AS min, round(avg(price), 4) AS mean, max(price) AS max,
  round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.9), 6) AS p90,
  round(quantile_cont(price, 0.95), 6) AS p95 FROM flows""")
def k15(spark: SparkSession, d: str) -> DataFrame:
    r = report.distance_report(flows(spark, d).select("price"), "price")
    return r.select("min", F.round("mean", 4).alias("mean"), "max",
                    *[F.round(p, 6).alias(p) for p in ("p50", "p90", "p95")])


@query("k15_distance_report_by_label", f"""WITH {FLOWS}
SELECT "Label", min(price) AS min, round(avg(price), 4) AS mean, max(price) AS max,
  round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.9), 6) AS p90,
  round(quantile_cont(price, 0.95), 6) AS p95 FROM flows GROUP BY "Label" """)
def k15_by_label(spark: SparkSession, d: str) -> DataFrame:
    r = report.distance_report(flows(spark, d).select("Label", "price"), "price", ["Label"])
    return r.select("Label", "min", F.round("mean", 4).alias("mean"), "max",
                    *[F.round(p, 6).alias(p) for p in ("p50", "p90", "p95")])
