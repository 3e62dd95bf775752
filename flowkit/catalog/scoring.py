"""Queries for merging, voting, metrics and robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.registry import query
from flowkit.catalog.standins import (
    IDS, JUDGED, K, MODELS, SKEWED, FLOWS, FLOW_HASH, judged, flows, probabilities,
    probabilities_sql, skewed, sql_hash, table,
)

from flowkit.operators import clean, score
from flowkit.spec import ENSEMBLE_WEIGHTS

ID_LIST = ", ".join(IDS)


@query("m1_merge_train", f"""WITH {FLOWS}, u AS (
  SELECT DISTINCT {ID_LIST}, "Label", CASE WHEN "Label" LIKE 'R%' THEN 'minor:' || "Label" || ':interpolate'
    ELSE 'major:' || "Label" END AS __source__ FROM flows)
SELECT *, row_number() OVER (ORDER BY {FLOW_HASH}) AS position FROM u""")
def m1(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).select(*IDS, "Label")
    part = lambda x: rows.where(F.col("Label") == x)
    return score.merge_train(
        [(x, part(x)) for x in ("AF", "AO", "NF", "NO")],
        [(x, "interpolate", part(x)) for x in ("RF", "RO")], IDS,
    )


@query("m2_test_sample", f"""WITH {SKEWED}, r AS (
  SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {sql_hash(42, ['event_id'])}) AS rn FROM skewed)
SELECT "Label", event_id, user_id FROM r WHERE rn <= 200""")
def m2(spark: SparkSession, d: str) -> DataFrame:
    return score.sample_test(skewed(spark, d), ["event_id"], 200)


@query("m3_probs_from_pred", f"""WITH {JUDGED}
SELECT sample_id, model, attack, """ + ", ".join(
    f"(plain_pred = {c})::INT::DOUBLE AS p{c}" for c in range(K)) + " FROM judged")
def m3(spark: SparkSession, d: str) -> DataFrame:
    return score.probs_from_pred(judged(spark, d), K, "plain_pred").select(
        "sample_id", "model", "attack", *[F.col("proba")[c].alias(f"p{c}") for c in range(K)]
    )


WEIGHT = "CASE model " + " ".join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in ENSEMBLE_WEIGHTS.items()) + " ELSE 0.0::DOUBLE END"


def voted_sql(source: str, keys: str = "sample_id", name: str = "voted") -> str:
    """Weighted vote of a table (keys, model, p0..); histgbm is preferred to gbm."""
    sums = ", ".join(f"sum(w * p{c}) / sum(w) AS p{c}" for c in range(K))
    tops = " ".join(f"WHEN p{c} THEN {c}" for c in range(K - 1))
    best = f"CASE greatest({', '.join(f'p{c}' for c in range(K))}) {tops} ELSE {K - 1} END"
    return f"""{name} AS (SELECT *, CAST({best} AS INTEGER) AS pred FROM (
  SELECT {keys}, {sums} FROM (SELECT *, {WEIGHT} AS w FROM {source} WHERE model <> 'gbm') WHERE w > 0 GROUP BY {keys}))"""


@query("m4_combine_weighted", f"""WITH {probabilities_sql()}, {voted_sql('probs')}
SELECT sample_id, pred, """ + ", ".join(f"round(p{c}, 6) AS p{c}" for c in range(K)) + " FROM voted")
def m4(spark: SparkSession, d: str) -> DataFrame:
    probs = clean.exclude_models(probabilities(spark, d))
    return score.combine_weighted(probs, K).select(
        "sample_id", "pred", *[F.round(F.col("proba")[c], 6).alias(f"p{c}") for c in range(K)]
    )


@query("m4_combine_unweighted", f"""WITH {probabilities_sql()}
SELECT sample_id, """ + ", ".join(f"round(avg(p{c}), 6) AS p{c}" for c in range(K)) + " FROM probs GROUP BY sample_id")
def m4_unweighted(spark: SparkSession, d: str) -> DataFrame:
    """No model has a weight, so the plain mean is taken."""
    return score.combine_weighted(probabilities(spark, d), K, {"nobody": 1.0}).select(
        "sample_id", *[F.round(F.col("proba")[c], 6).alias(f"p{c}") for c in range(K)]
    )


def _linear_model():
    """Fixed linear scores of a feature array, as a stand-in for a user's model."""
    import numpy as np

    def predict(x):
        x = np.asarray(x, dtype=float)
        z = np.stack([x @ np.roll(np.linspace(-1.0, 1.0, x.shape[1]), c) for c in range(K)], axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return predict


def _linear_sql() -> str:
    step = 2.0 / 63
    weights = lambda c: "[" + ", ".join(repr(-1.0 + step * ((i - c) % 64)) for i in range(64)) + "]::DOUBLE[]"
    zs = ", ".join(f"list_dot_product(v, {weights(c)}) AS z{c}" for c in range(K))
    return f"s AS (SELECT vec_id, {zs} FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"


@query("m5_score_batched", f"""WITH {_linear_sql()}, e AS (
  SELECT vec_id, exp(z0) AS e0, exp(z1) AS e1, exp(z2) AS e2, exp(z3) AS e3 FROM s)
SELECT vec_id, """ + ", ".join(f"round(e{c} / (e0 + e1 + e2 + e3), 6) AS p{c}" for c in range(K)) + " FROM e")
def m5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features")
    )
    return score.score_batched(rows, _linear_model, 64, batch_size=100).select(
        "vec_id", *[F.round(F.col("proba")[c], 6).alias(f"p{c}") for c in range(K)]
    )


def per_class_sql(pred: str, keys: str, name: str) -> str:
    """tp, support and predicted count per class, then metrics per key."""
    return f"""{name}_c AS (
  SELECT {keys}, cls, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT {keys}, y AS cls, 1 AS support, 0 AS predicted, (y = {pred})::INT AS tp FROM judged
    UNION ALL SELECT {keys}, {pred}, 0, 1, 0 FROM judged) GROUP BY {keys}, cls),
{name}_m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r,
    CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f FROM {name}_c),
{name} AS (SELECT {keys}, sum(tp) / sum(support) AS accuracy, avg(p) AS precision_macro, avg(r) AS recall_macro,
    avg(f) AS f1_macro, sum(p * support) / sum(support) AS precision_weighted,
    sum(r * support) / sum(support) AS recall_weighted, sum(f * support) / sum(support) AS f1_weighted
  FROM {name}_m GROUP BY {keys})"""


ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in score.METRICS)


def _rounded() -> list:
    return [F.round(m, 6).alias(m) for m in score.METRICS]


@query("m6_classification_metrics", f"""WITH {JUDGED}, {per_class_sql('pert_pred', 'model, attack', 'g')}
SELECT model, attack, {ROUNDED} FROM g""")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return score.classification_metrics(
        judged(spark, d), "y", "pert_pred", ["model", "attack"]
    ).select("model", "attack", *_rounded())


@query("m7_confusion_matrix", f"""WITH {JUDGED}, k AS (SELECT unnest(range({K}))::INTEGER AS c)
SELECT a.c AS y, b.c AS pert_pred, count(j.y) AS n FROM k a CROSS JOIN k b
LEFT JOIN judged j ON j.y = a.c AND j.pert_pred = b.c GROUP BY a.c, b.c""")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return score.confusion_matrix(judged(spark, d), list(range(K)), "y", "pert_pred")


ASR = """CASE WHEN count_if(plain_pred = y) > 0
  THEN count_if(plain_pred = y AND pert_pred <> y) / count_if(plain_pred = y) ELSE 0 END"""


@query("m8_asr", f"""WITH {JUDGED}
SELECT model, attack, count_if(plain_pred = y)::BIGINT AS plain_correct,
  count_if(plain_pred = y AND pert_pred <> y)::BIGINT AS successes, round({ASR}, 6) AS asr
FROM judged GROUP BY model, attack""")
def m8(spark: SparkSession, d: str) -> DataFrame:
    return score.asr(judged(spark, d), ["model", "attack"]).withColumn("asr", F.round("asr", 6))


VALUES = ("plain_acc", "plain_f1", "pert_acc", "pert_f1", "asr")
ROBUST = f"""{JUDGED}, {per_class_sql('plain_pred', 'model, attack', 'g')},
{per_class_sql('pert_pred', 'model, attack', 'h')},
a AS (SELECT model, attack, {ASR} AS asr FROM judged GROUP BY model, attack),
robust AS (SELECT g.model AS model, g.attack AS attack, g.accuracy AS plain_acc, g.f1_macro AS plain_f1,
    h.accuracy AS pert_acc, h.f1_macro AS pert_f1, asr
  FROM g JOIN h ON g.model = h.model AND g.attack = h.attack JOIN a ON g.model = a.model AND g.attack = a.attack)"""
TEXTS = ", ".join(f"printf('%.2f%%', {v} * 100.0::DOUBLE) AS {v}_text" for v in VALUES)
NUMBERS = ", ".join(f"round({v}, 6) AS {v}" for v in VALUES)


def _numbers() -> list:
    return [F.round(v, 6).alias(v) for v in VALUES]


@query("m9_robustness_table", f"WITH {ROBUST} SELECT model, attack, {NUMBERS}, {TEXTS} FROM robust")
def m9(spark: SparkSession, d: str) -> DataFrame:
    return score.robustness_table(judged(spark, d)).select(
        "model", "attack", *_numbers(), *[f"{v}_text" for v in VALUES]
    )


GRID = ", ".join(f"max(CASE WHEN model = '{m}' THEN cell END) AS {m}" for m in MODELS)


@query("m10_robustness_grid", f"""WITH {ROBUST}, t AS (SELECT model, attack, {TEXTS} FROM robust),
c AS (SELECT attack, model, pert_acc_text || ' (asr:' || asr_text || ')' AS cell FROM t
      UNION ALL SELECT 'original', model, max(plain_acc_text) || ' (asr:--)' FROM t GROUP BY model)
SELECT attack, {GRID} FROM c GROUP BY attack""")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return score.robustness_grid(score.robustness_table(judged(spark, d)), MODELS)


PERT_TAGS = {"flip": "f", "shift": "s"}


def ensemble_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plain, perturbed, truth) probability tables over the orders."""
    plain = clean.exclude_models(probabilities(spark, d))
    parts = [
        clean.exclude_models(probabilities(spark, d, tag)).withColumn("attack", F.lit(a))
        for a, tag in PERT_TAGS.items()
    ]
    truth = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % K).cast("int").alias("y")
    )
    return plain, parts[0].unionByName(parts[1]), truth


VOTES = f"""{probabilities_sql()}, {voted_sql('probs')},
{probabilities_sql('probs_f', 'f')}, {probabilities_sql('probs_s', 's')},
pert AS (SELECT 'flip' AS attack, * FROM probs_f UNION ALL SELECT 'shift', * FROM probs_s),
{voted_sql('pert', 'attack, sample_id', 'hit')}"""
VOTED_PAIRS = f"""SELECT 'ensemble' AS model, hit.attack AS attack, CAST(o_custkey % {K} AS INTEGER) AS y,
    voted.pred AS plain_pred, hit.pred AS pert_pred
  FROM orders JOIN voted ON o_orderkey = voted.sample_id JOIN hit ON o_orderkey = hit.sample_id"""


def ensemble_sql(pairs: str) -> str:
    """Robustness CTEs over the given pairs of predictions."""
    return f"{VOTES}, judged AS ({pairs}){ROBUST[len(JUDGED):]}"


@query("m11_ensemble_asr", f"WITH {ensemble_sql(VOTED_PAIRS)} SELECT model, attack, {NUMBERS}, {TEXTS} FROM robust")
def m11(spark: SparkSession, d: str) -> DataFrame:
    return score.ensemble_asr(*ensemble_inputs(spark, d), K).select(
        "model", "attack", *_numbers(), *[f"{v}_text" for v in VALUES]
    )


@query("m12_ablation_report", f"""WITH {ROBUST}
SELECT 'no defence' AS config, model, attack, {NUMBERS} FROM robust
UNION ALL SELECT 'perfect defence', model, attack, round(plain_acc, 6), round(plain_f1, 6),
  round(plain_acc, 6), round(plain_f1, 6), 0.0::DOUBLE FROM robust""")
def m12(spark: SparkSession, d: str) -> DataFrame:
    pairs = judged(spark, d)
    shielded = pairs.withColumn("pert_pred", F.col("plain_pred"))
    tables = {
        "no defence": score.robustness_table(pairs),
        "perfect defence": score.robustness_table(shielded),
    }
    return score.ablation_report(tables).select("config", "model", "attack", *_numbers())


@query("m13_model_summary", f"""WITH {JUDGED.replace('judged AS', 'all_judged AS', 1)},
judged AS (SELECT * FROM all_judged WHERE model <> 'beta'),
{per_class_sql('plain_pred', 'model', 'g')} SELECT model, {ROUNDED} FROM g""")
def m13(spark: SparkSession, d: str) -> DataFrame:
    """One model failed and has no predictions."""
    rows = judged(spark, d).withColumn(
        "plain_pred", F.when(F.col("model") != "beta", F.col("plain_pred"))
    )
    return score.model_summary(rows, "y", "plain_pred").select("model", *_rounded())


