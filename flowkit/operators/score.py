"""Ensemble voting, classification metrics and robustness tables.

Metrics are derived from cell counts: one aggregate over the predictions, then a few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkit.functions import argmax_class, col, one_hot_vector, percent_text
from flowkit.operators.clean import tag
from flowkit.operators.dedup import align_by_id, dedup, union_aligned
from flowkit.operators.sample import cap_per_label, shuffle
from flowkit.spec import ENSEMBLE_WEIGHTS
from flowkit.staging import stage

METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro",
           "precision_weighted", "recall_weighted", "f1_weighted")


# ---- merging the parts ----------------------------------------------------------------------

def merge_train(
    majority: Sequence[tuple[str, DataFrame]], minority: Sequence[tuple[str, str, DataFrame]],
    ids: Sequence[str], seed: int = 42,
) -> DataFrame:
    """Distinct rows of each part with their source tag, columns aligned, in a total random order.

    `majority` is (label, rows); `minority` is (label, strategy, rows). The order is the column
    `position`.
    """
    parts = [tag(df, "__source__", "major", label) for label, df in majority]
    parts += [
        tag(df, "__source__", "minor", label, strategy) for label, strategy, df in minority
    ]
    # one shuffle for all parts: distinct parts that are then united can end up in a single task
    numbered = [df.withColumn("__part__", F.lit(n)) for n, df in enumerate(parts)]
    return shuffle(stage(dedup(union_aligned(numbered)).drop("__part__")), ids, seed)


def sample_test(
    df: DataFrame, ids: Sequence[str], tau: int, label: str = "Label", seed: int = 42
) -> DataFrame:
    """Capped test sample with columns in sorted order."""
    return union_aligned([cap_per_label(df, ids, tau, label, seed)])


# ---- probabilities --------------------------------------------------------------------------

def probs_from_pred(df: DataFrame, k: int, pred: str = "pred", name: str = "proba") -> DataFrame:
    """Probability row of a model that gives only a class."""
    return df.withColumn(name, one_hot_vector(col(pred), k))


def score_batched(
    df: DataFrame, make_predict: Callable, dim: int, batch_size: int = 10_000,
    vector: str = "features", name: str = "proba",
) -> DataFrame:
    """Score feature arrays of length `dim` with a user model in Arrow batches of a fixed size.

    `make_predict` is called once per worker and returns a numpy function (n, d) -> (n, k).
    """
    predict = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[dim]],
    )
    return df.withColumn(name, predict(col(vector)))


def _weight_of(model: Column, weights: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(model == m, F.lit(float(w))) for m, w in weights.items()], F.lit(0.0))


def combine_weighted(
    probs: DataFrame, k: int, weights: dict[str, float] | None = None,
    keys: Sequence[str] = ("sample_id",), model: str = "model", proba: str = "proba",
) -> DataFrame:
    """Weighted vote per sample: (keys, proba, pred).

    Models without a positive weight or with another number of classes do not count; the sum is
    divided by the weight used. When nothing counts, the plain mean is taken.
    """
    w = _weight_of(col(model), ENSEMBLE_WEIGHTS if weights is None else weights)
    wide = F.size(col(proba)) == k
    used = F.when(wide & (w > 0), w)
    sums = [F.sum(used * F.get(col(proba), F.lit(i))).alias(f"s{i}") for i in range(k)]
    means = [F.avg(F.when(wide, F.get(col(proba), F.lit(i)))).alias(f"m{i}") for i in range(k)]
    votes = probs.groupBy(*[col(c) for c in keys]).agg(F.sum(used).alias("__w__"), *sums, *means)
    mixed = F.array(*[
        F.when(F.col("__w__") > 0, F.col(f"s{i}") / F.col("__w__")).otherwise(F.col(f"m{i}"))
        for i in range(k)
    ])
    return votes.select(*[col(c) for c in keys], mixed.alias("proba")).withColumn(
        "pred", argmax_class(F.col("proba"))
    )


# ---- metrics --------------------------------------------------------------------------------

def _per_class(cells: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """tp, support and predicted count per class from (keys, y, p, n)."""
    zero = F.lit(0).cast("bigint")
    n, hit = F.col("n"), F.when(col(y) == col(p), F.col("n")).otherwise(zero)
    views = F.explode(F.array(
        F.struct(col(y).alias("cls"), n.alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(col(p).alias("cls"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")),
    ))
    return (
        cells.select(*[col(k) for k in keys], views.alias("__x__"))
        .select(*[col(k) for k in keys], "__x__.*")
        .groupBy(*[col(k) for k in keys], "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )


def class_metrics(
    df: DataFrame, y: str = "y", p: str = "pred", keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """precision, recall, F1 and support per class."""
    n = F.count("*") if weight is None else F.sum(col(weight))
    cells = df.groupBy(*[col(k) for k in keys], col(y), col(p)).agg(n.alias("n"))
    per = _per_class(cells, keys, y, p)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return per.select(
        *[col(k) for k in keys], "cls", "support", "tp",
        safe(tp, F.col("predicted")).alias("precision"),
        safe(tp, F.col("support")).alias("recall"),
        safe(2 * tp, F.col("predicted") + F.col("support")).alias("f1"),
    )


def classification_metrics(
    df: DataFrame, y: str = "y", p: str = "pred", keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """accuracy, and macro and weighted precision, recall and F1; one row per key."""
    per = class_metrics(df, y, p, keys, weight)
    total = F.sum("support")
    macro = [F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    weighted = [
        (F.sum(F.col(m) * F.col("support")) / total).alias(f"{m}_weighted")
        for m in ("precision", "recall", "f1")
    ]
    return per.groupBy(*[col(k) for k in keys]).agg(
        (F.sum("tp") / total).alias("accuracy"), *macro, *weighted
    )


def confusion_matrix(
    df: DataFrame, classes: Sequence, y: str = "y", p: str = "pred"
) -> DataFrame:
    """(y, pred, n) for every pair of classes, empty cells included."""
    cells = df.groupBy(col(y), col(p)).agg(F.count("*").alias("n"))
    listed = F.array(*[F.lit(c) for c in classes])
    # the grid comes from the class list, not from the data
    grid = (
        df.sparkSession.range(1).select(F.explode(listed).alias(y))
        .select(col(y), F.explode(listed).alias(p))
    )
    return grid.join(cells, [y, p], "left").na.fill(0, ["n"])


def asr(
    pairs: DataFrame, keys: Sequence[str] = (), y: str = "y", plain: str = "plain_pred",
    pert: str = "pert_pred",
) -> DataFrame:
    """Attack success rate: share of rightly predicted plain samples that turn wrong."""
    right = col(plain) == col(y)
    lost = right & (col(pert) != col(y))
    return pairs.groupBy(*[col(k) for k in keys]).agg(
        F.count_if(right).alias("plain_correct"), F.count_if(lost).alias("successes"),
    ).withColumn(
        "asr",
        F.when(F.col("plain_correct") > 0, F.col("successes") / F.col("plain_correct")).otherwise(0.0),
    )


def robustness_table(
    pairs: DataFrame, keys: Sequence[str] = ("model", "attack"), y: str = "y",
    plain: str = "plain_pred", pert: str = "pert_pred",
) -> DataFrame:
    """Plain and perturbed accuracy and F1, and ASR, per model and attack; also as text.

    One pass: the rows are counted per cell, and each cell then speaks for its class as truth and
    as prediction, plain and perturbed.
    """
    names = [col(k) for k in keys]
    cells = pairs.groupBy(*names, col(y), col(plain), col(pert)).agg(F.count("*").alias("w"))
    w, zero = F.col("w"), F.lit(0).cast("bigint")
    right = col(plain) == col(y)

    def view(side: str, cls: str, truth: bool) -> Column:
        p = col(plain if side == "plain" else pert)
        counted = truth and side == "plain"
        return F.struct(
            F.lit(side).alias("side"), col(cls).alias("cls"),
            (w if truth else zero).alias("support"), (zero if truth else w).alias("predicted"),
            (F.when(p == col(y), w).otherwise(zero) if truth else zero).alias("tp"),
            (F.when(right, w).otherwise(zero) if counted else zero).alias("right"),
            (F.when(right & (col(pert) != col(y)), w).otherwise(zero) if counted else zero).alias("lost"),
        )

    views = F.explode(F.array(
        view("plain", y, True), view("plain", plain, False),
        view("pert", y, True), view("pert", pert, False),
    ))
    per_class = (
        cells.select(*names, views.alias("__x__")).select(*names, "__x__.*")
        .groupBy(*names, "side", "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp", "right", "lost")])
    )
    both = F.col("predicted") + F.col("support")
    f1 = F.when(both > 0, 2 * F.col("tp") / both).otherwise(0.0)

    def of(side: str, c: Column) -> Column:
        return F.when(F.col("side") == side, c)

    measures = []
    for side in ("plain", "pert"):
        hits, n = F.sum(of(side, F.col("tp"))), F.sum(of(side, F.col("support")))
        measures += [(hits / n).alias(f"{side}_acc"), F.avg(of(side, f1)).alias(f"{side}_f1")]
    rights, losses = F.sum("right"), F.sum("lost")
    rate = F.when(rights > 0, losses / rights).otherwise(0.0).alias("asr")
    table = per_class.groupBy(*names).agg(*measures, rate)
    values = ("plain_acc", "plain_f1", "pert_acc", "pert_f1", "asr")
    return table.select(*names, *values, *[percent_text(F.col(v)).alias(f"{v}_text") for v in values])


def robustness_grid(table: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows `original` and the attacks, one column per model, cells `accuracy (asr:rate)`."""
    cell = F.concat(F.col("acc"), F.lit(" (asr:"), F.col("rate"), F.lit(")"))
    attacks = table.select(
        "attack", "model", F.col("pert_acc_text").alias("acc"), F.col("asr_text").alias("rate")
    )
    original = table.groupBy("model").agg(F.max("plain_acc_text").alias("acc")).select(
        F.lit("original").alias("attack"), "model", "acc", F.lit("--").alias("rate")
    )
    return (
        original.unionByName(attacks).withColumn("cell", cell)
        .groupBy("attack").pivot("model", list(models)).agg(F.first("cell"))
        .na.fill("nan (asr:nan)")
    )


def ensemble_asr(
    plain: DataFrame, pert: DataFrame, truth: DataFrame, k: int,
    weights: dict[str, float] | None = None, ids: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """Robustness of the vote: each model scores its own perturbed samples.

    `plain` is (ids, model, proba), `pert` the same with `attack`, `truth` (ids, y).
    """
    voted = combine_weighted(plain, k, weights, ids).select(*ids, F.col("pred").alias("plain_pred"))
    hit = combine_weighted(pert, k, weights, ["attack", *ids]).select(
        "attack", *ids, F.col("pred").alias("pert_pred")
    )
    pairs = align_by_id(align_by_id(truth, voted, ids), hit, ids)
    return robustness_table(pairs.withColumn("model", F.lit("ensemble")))


def ablation_report(tables: dict[str, DataFrame]) -> DataFrame:
    """The same robustness table under several defence settings, with a `config` column."""
    return reduce(
        DataFrame.unionByName, [t.withColumn("config", F.lit(c)) for c, t in tables.items()]
    )


def model_summary(
    predictions: DataFrame, y: str = "y", p: str = "pred", model: str = "model"
) -> DataFrame:
    """Metrics per model; predictions that are missing do not count, so failed models drop out."""
    return classification_metrics(predictions.where(col(p).isNotNull()), y, p, [model])
