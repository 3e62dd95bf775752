"""Queries for admission control of synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.deduping import ORDER_KEYS, ORDERS, _orders
from flowkit.catalog.registry import query
from flowkit.catalog.sampling import VEC_HASH, placed
from flowkit.catalog.standins import FLOWS, IDS, SKEWED, VECTORS, flows, skewed, sql_hash, vectors
from flowkit.operators import augment

NEED = """need AS (SELECT "Label", count(*) AS rows, greatest(1200 - count(*), 0)::BIGINT AS need
  FROM skewed GROUP BY "Label")"""


@query("g1_need", f"WITH {SKEWED}, {NEED} SELECT * FROM need")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return augment.need_per_label(skewed(spark, d), 1200)


@query("g2_request_size", f"""WITH {SKEWED}, {NEED}, r AS (
  SELECT *, CASE "Label" WHEN 'rare' THEN 0.0001::DOUBLE WHEN 'scarce' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS rate FROM need)
SELECT "Label", need, CAST(floor(least(greatest(need * 3.0::DOUBLE, need / greatest(rate, 0.001::DOUBLE) * 3.0::DOUBLE), 60000)) AS BIGINT) AS request FROM r""")
def g2(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("Label") == "rare", 0.0001).when(F.col("Label") == "scarce", 0.5).otherwise(0.3)
    return augment.need_per_label(skewed(spark, d), 1200).select(
        "Label", "need", augment.request_size(F.col("need"), rate).alias("request")
    )


@query("g3_accept_top", f"""WITH {VECTORS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY dist DESC, {VEC_HASH}) AS rn,
         count(*) OVER (PARTITION BY "Label") AS n FROM placed)
SELECT vec_id, "Label" FROM r WHERE rn <= ceil(0.3::DOUBLE * n)""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return augment.accept_top(
        placed(spark, d), ["vec_id"], 0.3, ["Label"], score="dist"
    ).select("vec_id", "Label")


@query("g3_critic")
def g3_critic(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one cluster scored against the other clusters."""
    rows = vectors(spark, d)
    critic = augment.fit_critic(rows.where("cluster = 1"), rows.where("cluster <> 1"))
    return augment.critic_score(rows, critic).select("vec_id", "score")


@query("g4_admit", f"""WITH {ORDERS}, c AS (
  SELECT priority, year, bucket, min(o_orderkey) AS o_orderkey FROM keyed WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT o_orderkey, priority, year, bucket FROM c WHERE NOT EXISTS (
  SELECT 1 FROM keyed b WHERE b.o_orderstatus IN ('F', 'P') AND b.priority = c.priority
    AND b.year = c.year AND b.bucket = c.bucket)""")
def g4(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).drop("o_totalprice")
    side = lambda s: rows.where(F.col("o_orderstatus") == s)
    return augment.admit(side("O"), [side("F"), side("P")], ORDER_KEYS, ["o_orderkey"]).drop(
        "o_orderstatus"
    )


FEATURES = ["quantity", "price"]


def _generator(rows: DataFrame):
    """New rows between flows; quantity to whole numbers, so that repeats do occur."""
    def generate(turn: int, n: int) -> DataFrame:
        made = augment.interpolate(rows, n, IDS, FEATURES, seed=turn)
        return made.withColumn("quantity", F.rint("quantity")).withColumn(
            "price", F.rint(F.col("price") / 100.0) * 100.0
        )

    return generate


@query("g5_augment_until", f"""WITH {FLOWS}
SELECT 3000::BIGINT AS rows, 3000::BIGINT AS distinct_rows, 0::BIGINT AS known,
  count_if("Label" = 'RO')::BIGINT AS originals FROM flows""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    """Rounds until there are enough new rows: how many, how many distinct, how many known."""
    return _augmented(spark, d, 3000, 40)


@query("g6_final_fill", f"""WITH {FLOWS}
SELECT 3000::BIGINT AS rows, 3000::BIGINT AS distinct_rows, 0::BIGINT AS known,
  count_if("Label" = 'RO')::BIGINT AS originals FROM flows""")
def g6(spark: SparkSession, d: str) -> DataFrame:
    """Fewer rounds than needed would do; the last batch brings what is missing."""
    return _augmented(spark, d, 3000, 2)


def _augmented(spark: SparkSession, d: str, need: int, rounds: int) -> DataFrame:
    everything = flows(spark, d)
    rows = everything.where("Label = 'RO'")
    new = augment.augment_until(
        _generator(rows), [everything], FEATURES, ["gen_id"], need, max_rounds=rounds
    )
    seen = new.join(everything, FEATURES, "left_semi").agg(F.count("*").alias("k"))
    originals = rows.agg(F.count("*").alias("o"))
    return new.agg(
        F.count("*").alias("rows"), F.count_distinct(*FEATURES).alias("distinct_rows")
    ).select("*", seen.scalar().alias("known"), originals.scalar().alias("originals"))


@query("g7_merge_augmented", f"""WITH {FLOWS}
SELECT DISTINCT quantity, price, "Label" FROM flows WHERE "Label" IN ('RF', 'RO')""")
def g7(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).select("quantity", "price", "Label")
    accepted = rows.where("Label = 'RO' OR (Label = 'RF' AND quantity > 40)").withColumn("x", F.lit(1))
    return augment.merge_augmented(rows.where("Label = 'RF'"), accepted)


@query("g8_interpolate", f"""WITH {FLOWS}, p AS (
  SELECT *, row_number() OVER (ORDER BY {sql_hash(42, IDS)}) AS pos FROM flows WHERE "Label" = 'RF'),
m AS (SELECT count(*) AS m FROM p),
j AS (SELECT range AS gen_id, range % m + 1 AS a, range // m % greatest(m - 1, 1) + 1 AS step, m FROM range(25000), m),
k AS (SELECT gen_id, a, (a - 1 + step) % m + 1 AS b,
        CAST(('0x' || substr(md5(concat_ws('|', '42', gen_id)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM j)
SELECT gen_id, x.l_orderkey, round(x.quantity + u * (y.quantity - x.quantity), 6) AS quantity,
  round(x.price + u * (y.price - x.price), 6) AS price
FROM k JOIN p x ON x.pos = a JOIN p y ON y.pos = b""")
def g8(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).where("Label = 'RF'")
    return augment.interpolate(rows, 25_000, IDS, FEATURES).select(
        "gen_id", "l_orderkey", F.round("quantity", 6).alias("quantity"), F.round("price", 6).alias("price")
    )
