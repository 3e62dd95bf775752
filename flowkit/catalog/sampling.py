"""Queries for splits, samples and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.registry import query
from flowkit.catalog.standins import (
    ATTACKS, FEATURES, FLOW_HASH, FLOWS, IDS, MERGED, SKEWED, VECTORS, flows,
    probabilities, probabilities_sql, skewed, sources, sql_hash, vectors,
)
from flowkit.functions import argmax_class
from flowkit.operators import clean, compress, dedup, sample

ID_LIST = ", ".join(IDS)


@query("w1_split_by_label", f"""WITH {FLOWS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {FLOW_HASH}) AS rn,
         count(*) OVER (PARTITION BY "Label") AS n FROM flows)
SELECT {ID_LIST}, "Label", CASE WHEN rn <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS subset
FROM r WHERE n >= 2""")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return sample.split_by_label(flows(spark, d).select(*IDS, "Label"), IDS)


@query("w1_split_skewed", f"""WITH {SKEWED}, r AS (
  SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {sql_hash(42, ['event_id'])}) AS rn,
         count(*) OVER (PARTITION BY "Label") AS n FROM skewed)
SELECT event_id, "Label", CASE WHEN rn <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS subset
FROM r WHERE n >= 2""")
def w1_skewed(spark: SparkSession, d: str) -> DataFrame:
    return sample.split_by_label(skewed(spark, d).select("event_id", "Label"), ["event_id"])


STRATIFIED = """c AS (SELECT "Label", count(*) AS n FROM skewed GROUP BY "Label"),
t AS (SELECT ceil(sum(n) * 0.1::DOUBLE) AS t, sum(n) AS s FROM c),
b AS (SELECT "Label", n * t / s AS share, floor(n * t / s) AS base, t FROM c, t),
q AS (SELECT "Label", base + CASE WHEN row_number() OVER (ORDER BY round(share - base, 9) DESC, "Label")
        <= t - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b)"""


@query("w2_stratified_split", f"""WITH {SKEWED}, {STRATIFIED}, r AS (
  SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {sql_hash(42, ['event_id'])}) AS rn FROM skewed)
SELECT event_id, r."Label" AS "Label", CASE WHEN rn <= quota THEN 'val' ELSE 'train' END AS subset
FROM r JOIN q ON r."Label" = q."Label" """)
def w2(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified_split(skewed(spark, d).select("event_id", "Label"), ["event_id"])


def _first(n: str, seed: int = 42, table: str = "skewed") -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY "Label"
      ORDER BY {sql_hash(seed, ['event_id'])}) AS rn FROM {table})
SELECT event_id, r."Label" AS "Label" FROM r {n}"""


@query("w3_cap_per_label", f"""WITH {SKEWED}, {_first('WHERE rn <= 150')}""")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return sample.cap_per_label(skewed(spark, d).select("event_id", "Label"), ["event_id"], 150)


@query("w4_shuffle", f"""WITH {FLOWS}
SELECT {ID_LIST}, row_number() OVER (ORDER BY {FLOW_HASH}) AS position FROM flows""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return sample.shuffle(flows(spark, d).select(*IDS), IDS)


@query("w5_take_first", f"""WITH {FLOWS} SELECT {ID_LIST} FROM flows ORDER BY {ID_LIST} LIMIT 500""")
def w5_first(spark: SparkSession, d: str) -> DataFrame:
    return sample.take_rows(flows(spark, d).select(*IDS), 500, IDS)


@query("w5_take_random", f"""WITH {FLOWS} SELECT {ID_LIST} FROM flows ORDER BY {FLOW_HASH} LIMIT 500""")
def w5_random(spark: SparkSession, d: str) -> DataFrame:
    return sample.take_rows(flows(spark, d).select(*IDS), 500, IDS, "random")


@query("w6_fallback_sample", f"""WITH {FLOWS} SELECT {ID_LIST} FROM flows ORDER BY {FLOW_HASH} LIMIT 100""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return sample.fallback_sample(flows(spark, d).select(*IDS), IDS)


EQUAL = """c AS (SELECT "Label", count(*) AS avail FROM skewed GROUP BY "Label"),
e AS (SELECT "Label", avail, {t} // (SELECT count(*) FROM c)
        + (row_number() OVER (ORDER BY "Label") <= {t} % (SELECT count(*) FROM c))::INT AS share FROM c)"""


@query("w7_allocate_quotas", f"""WITH {SKEWED}, {EQUAL.format(t=1000)}
SELECT "Label", share::BIGINT AS quota FROM e""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return sample.allocate_quotas(skewed(spark, d).select("Label").distinct(), 1000)


@query("w8_balanced_sample", f"""WITH {SKEWED}, {EQUAL.format(t=1000)},
{_first('JOIN e ON r."Label" = e."Label" WHERE rn <= share', 1337)}""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return sample.balanced_sample(skewed(spark, d).select("event_id", "Label"), ["event_id"], 1000)


CURRENT = """k AS (SELECT "Label", count(*) // 20 AS cur FROM skewed WHERE "Label" IN ('bulk', 'rare', 'click') GROUP BY "Label")"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    rows = skewed(spark, d).where(F.col("Label").isin("bulk", "rare", "click"))
    return rows.groupBy("Label").agg(F.floor(F.count("*") / 20).alias("rows"))


@query("w9_balanced_sample_capped", f"""WITH {SKEWED}, {EQUAL.format(t=1000)}, {CURRENT},
q AS (SELECT e."Label", greatest(0, least(share, 260 - coalesce(cur, 0), avail)) AS quota
      FROM e LEFT JOIN k ON e."Label" = k."Label"),
{_first('JOIN q ON r."Label" = q."Label" WHERE rn <= quota', 1337)}""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return sample.balanced_sample_capped(
        skewed(spark, d).select("event_id", "Label"), ["event_id"], 1000, 260, _current(spark, d)
    )


@query("w10_fill_capped", f"""WITH {SKEWED}, {EQUAL.format(t=1000)}, {CURRENT},
m AS (SELECT e."Label", greatest(0, least(avail, 260 - coalesce(cur, 0))) AS room
      FROM e LEFT JOIN k ON e."Label" = k."Label"),
q AS (SELECT "Label", greatest(0, least(room, 700 - coalesce(sum(room) OVER (ORDER BY "Label"
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM m),
{_first('JOIN q ON r."Label" = q."Label" WHERE rn <= quota', 1337)}""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return sample.fill_capped(
        skewed(spark, d).select("event_id", "Label"), ["event_id"], 700, 260, _current(spark, d)
    )


THRESHOLD = 400


def balance_sql(threshold: int) -> str:
    """The three phases as SQL; the third is one step per source in name order."""
    h = sql_hash(1337, FEATURES)
    cap = f"CAST(ceil({threshold}::DOUBLE / (SELECT count(DISTINCT \"Label\") FROM merged) * 2.0) AS BIGINT)"
    text = f"""WITH {MERGED}, m AS (
  SELECT *, contains(__attack__, '|') AS shared, {h} AS h FROM merged),
c1 AS (SELECT __attack__ AS a, "Label", count(*) AS avail FROM m WHERE NOT shared GROUP BY ALL),
g1 AS (SELECT a, least({threshold}, sum(avail)) AS t, count(*) AS k FROM c1 GROUP BY a),
p1 AS (SELECT c1.a, "Label", avail, greatest(0, least(t // k + (row_number() OVER (PARTITION BY c1.a
         ORDER BY "Label") <= t % k)::INT, {cap}, avail)) AS take1 FROM c1 JOIN g1 ON c1.a = g1.a),
n1 AS (SELECT a, {threshold} - sum(take1) AS need FROM p1 GROUP BY a),
r1 AS (SELECT p1.a, "Label", take1, need, greatest(0, least(avail - take1, {cap} - take1)) AS room
       FROM p1 JOIN n1 ON p1.a = n1.a),
q1 AS (SELECT a, "Label", take1 + greatest(0, least(room, need - coalesce(sum(room) OVER (PARTITION BY a
         ORDER BY "Label" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM r1),
s0 AS (SELECT m.f1, m.f2, m."Label", __attack__ FROM (
         SELECT *, row_number() OVER (PARTITION BY __attack__, "Label" ORDER BY h) AS rn FROM m WHERE NOT shared) m
       JOIN q1 ON q1.a = m.__attack__ AND q1."Label" = m."Label" WHERE rn <= take)"""
    done = []
    for i, a in enumerate(ATTACKS, start=1):
        unused = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM {s} u WHERE u.f1 = m.f1 AND u.f2 = m.f2)" for s in done
        )
        text += f""",
f{i} AS (SELECT f1, f2, "Label", row_number() OVER (PARTITION BY "Label" ORDER BY h) AS rn,
           count(*) OVER (PARTITION BY "Label") AS avail FROM m
         WHERE shared AND list_contains(string_split(__attack__, '|'), '{a}'){unused}),
k{i} AS (SELECT "Label", count(*) AS cur FROM s0 WHERE __attack__ = '{a}' GROUP BY "Label"),
m{i} AS (SELECT DISTINCT f."Label", greatest(0, least(avail, {cap} - coalesce(cur, 0))) AS room
         FROM f{i} f LEFT JOIN k{i} k ON f."Label" = k."Label"),
q{i}x AS (SELECT "Label", greatest(0, least(room, {threshold} - (SELECT count(*) FROM s0 WHERE __attack__ = '{a}')
         - coalesce(sum(room) OVER (ORDER BY "Label" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM m{i}),
s{i} AS (SELECT f1, f2, f."Label" AS "Label", '{a}' AS __attack__ FROM f{i} f JOIN q{i}x q ON f."Label" = q."Label" WHERE rn <= take)"""
        done.append(f"s{i}")
    return text + " " + " UNION ALL ".join(f"SELECT * FROM {s}" for s in ["s0", *done])


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return clean.with_row_key(
        dedup.merge_sources(sources(spark, d), FEATURES, ["event_id"]), FEATURES
    )


@query("w11_balance_sources", balance_sql(THRESHOLD))
def w11(spark: SparkSession, d: str) -> DataFrame:
    return sample.balance_sources(_merged(spark, d), THRESHOLD, FEATURES).drop("_key_")


@query("w12_trim_to_need", f"""WITH {SKEWED} SELECT event_id, "Label" FROM skewed ORDER BY event_id LIMIT 321""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return sample.trim_to_need(skewed(spark, d).select("event_id", "Label"), ["event_id"], 321)


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with their distance to the mean of the given cluster, to 6 decimals."""
    rows = vectors(spark, d)
    return compress.distance_to_center(rows, compress.group_centers(rows, 64)).withColumn(
        "dist", F.round("dist", 6)
    )


VEC_HASH = sql_hash(42, ["vec_id"])


@query("w13_top_closest", f"""WITH {VECTORS} SELECT vec_id, dist FROM placed ORDER BY dist, {VEC_HASH} LIMIT 37""")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return sample.top_closest(placed(spark, d), 37, ["vec_id"]).select("vec_id", "dist")


@query("w13_top_closest_ties", f"""WITH {FLOWS} SELECT {ID_LIST}, quantity FROM flows
ORDER BY quantity, {FLOW_HASH} LIMIT 2000""")
def w13_ties(spark: SparkSession, d: str) -> DataFrame:
    """Fifty distinct values only, so the cut falls inside a large group of equal ones."""
    return sample.top_closest(flows(spark, d), 2000, IDS, "quantity").select(*IDS, "quantity")


@query("w14_argmin_per_group", f"""WITH {VECTORS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, {VEC_HASH}) AS rn FROM placed)
SELECT cluster, vec_id, dist FROM r WHERE rn = 1""")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return sample.argmin_per_group(placed(spark, d), ["cluster"], ["vec_id"])


@query("w15_argmax_class", f"""WITH {probabilities_sql()}
SELECT sample_id, model, CAST(CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2
  ELSE 3 END AS INTEGER) AS pred FROM probs""")
def w15(spark: SparkSession, d: str) -> DataFrame:
    return probabilities(spark, d).select("sample_id", "model", argmax_class(F.col("proba")).alias("pred"))
