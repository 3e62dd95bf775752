"""Admission control for synthetic rows of small classes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.functions import col, hash_unit, order_hash
from flowkit.operators.dedup import dedup, dedup_by_features, exclude_known_multi
from flowkit.operators.known import KnownRows
from flowkit.operators.ranking import first_rows, hash_rank, take_smallest
from flowkit.staging import stage

# Multiplier, floor of the rate, and largest request of one round.
REQUEST_MULTIPLIER = 3.0
RATE_FLOOR = 1e-3
# A usual size of one request; callers may set another one, or None for no limit.
MAX_REQUEST = 60_000
# Rounds without a new row after which the generator counts as exhausted.
PATIENCE = 3

Generator = Callable[[int, int], DataFrame]


def need_per_label(df: DataFrame, tau: int, label: str = "Label") -> DataFrame:
    """(label, rows, need): rows missing up to `tau`, zero when there are enough."""
    return df.groupBy(col(label)).agg(F.count("*").alias("rows")).withColumn(
        "need", F.greatest(F.lit(tau) - F.col("rows"), F.lit(0)).cast("bigint")
    )


def request_size(
    need: Column, rate: Column, mult: float = REQUEST_MULTIPLIER, most: int | None = MAX_REQUEST
) -> Column:
    """Rows to ask the generator for in one round."""
    by_rate = need / F.greatest(rate, F.lit(RATE_FLOOR)) * mult
    wanted = F.greatest(need * mult, by_rate)
    return (wanted if most is None else F.least(wanted, F.lit(float(most)))).cast("bigint")


def request_rows(
    need: int, rate: float, mult: float = REQUEST_MULTIPLIER, most: int | None = MAX_REQUEST
) -> int:
    wanted = max(need * mult, need / max(rate, RATE_FLOOR) * mult)
    return int(wanted if most is None else min(wanted, most))


def fit_critic(
    rows: DataFrame, opposite: DataFrame, vector: str = "features"
) -> LogisticRegressionModel:
    """Score model: rows of the label against rows of the opposite label."""
    def side(df: DataFrame, y: float) -> DataFrame:
        return df.select(
            array_to_vector(col(vector).cast("array<double>")).alias("__x__"), F.lit(y).alias("__y__")
        )

    both = side(rows, 1.0).unionByName(side(opposite, 0.0))
    return LogisticRegression(featuresCol="__x__", labelCol="__y__").fit(both)


def critic_score(
    df: DataFrame, critic: LogisticRegressionModel, vector: str = "features", name: str = "score"
) -> DataFrame:
    rows = df.withColumn("__x__", array_to_vector(col(vector).cast("array<double>")))
    scored = critic.transform(rows)
    return scored.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def accept_top(
    df: DataFrame, ids: Sequence[str], rate: float, keys: Sequence[str] = (), score: str = "score",
    seed: int = 42,
) -> DataFrame:
    """The best `ceil(rate * n)` rows by score, per group."""
    sizes = df.groupBy(*[col(k) for k in keys]).agg(
        F.ceil(F.count("*") * F.lit(rate)).alias("quota")
    )
    low = df.withColumn("__low__", -col(score))
    return take_smallest(low, keys, "__low__", ids, sizes, seed).drop("__low__")


def admit(
    candidates: DataFrame, known: Sequence[DataFrame], features: Sequence[str],
    order: Sequence[str | Column],
) -> DataFrame:
    """New rows only: distinct by features in the batch, then not in any known table."""
    return exclude_known_multi(dedup_by_features(candidates, features, order), known, features)


def augment_until(
    generate: Generator, known: Sequence[DataFrame], features: Sequence[str],
    order: Sequence[str | Column], need: int, rate: float = 0.30,
    score: Callable[[DataFrame], DataFrame] | None = None, ids: Sequence[str] = ("gen_id",),
    max_rounds: int | None = None, final_fill: bool = True, most: int | None = MAX_REQUEST,
    short: str | None = None,
) -> DataFrame | None:
    """Generate, score, admit, until `need` rows are there.

    Without `max_rounds` it goes on while rounds bring new rows, and gives up after a few that do
    not. `short` says what happens when rows are missing in the end: "raise" (the default without
    `max_rounds`) or "return" what there is (the default where the caller limits the rounds).

    Candidates meet the known and accepted rows through a Bloom filter (`KnownRows`), so that a round
    shuffles its batch, not the known tables.

    `generate(round, n)` gives `n` candidate rows in raw form. Each round's accepted rows are
    written to the shared folder and only counted on the driver. The last step trims to the need,
    or asks once more for what is missing.
    """
    accepted: list[DataFrame] = []
    seen = KnownRows(known, features)
    have, turn, idle = 0, 0, 0
    while have < need and idle < PATIENCE and (max_rounds is None or turn < max_rounds):
        turn += 1
        batch = generate(turn, request_rows(need - have, rate, most=most))
        if score is not None:
            batch = accept_top(stage(score(batch)), ids, rate)
        fresh = stage(seen.exclude(dedup_by_features(batch, features, order)))
        count = fresh.count()
        idle = 0 if count else idle + 1
        if count:
            seen.add(fresh)
            accepted.append(fresh.withColumn("__round__", F.lit(turn)))
            have += count
    if final_fill and have < need:
        batch = generate(turn + 1, need - have)
        extra = stage(seen.exclude(dedup_by_features(batch, features, order)))
        accepted.append(extra.withColumn("__round__", F.lit(turn + 1)))
        have += extra.count()
    if have < need and (short or ("raise" if max_rounds is None else "return")) == "raise":
        raise ValueError(f"{need - have} of {need} rows are missing: the generator gives no more new ones")
    if not accepted:
        return None
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), accepted)
    return first_rows(merged, ["__round__", *ids], need).drop("__round__")


def merge_augmented(original: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Originals and accepted rows, full-row distinct; without accepted rows the originals pass."""
    if accepted is None:
        return dedup(original)
    keep = [col(c) for c in original.columns]
    return dedup(original.unionByName(accepted.select(*keep)))


def interpolate(
    df: DataFrame, n: int, ids: Sequence[str], numeric: Sequence[str], seed: int = 42,
    name: str = "gen_id",
) -> DataFrame:
    """`n` rows between two rows of `df`: `x + u * (other - x)`.

    Rows have a hashed position; the j-th new row joins two positions, and `u` is hashed from j.
    Columns that are not numeric come from the first row.
    """
    spark: SparkSession = df.sparkSession
    ranked = stage(hash_rank(df, [], ids, seed, "__pos__"))
    m = ranked.count()
    if m == 0:
        return df.limit(0).withColumn(name, F.lit(0).cast("bigint"))
    # round r of the positions pairs each of them with the one r + 1 further on
    step = F.floor(F.col(name) / m) % F.lit(max(m - 1, 1)) + 1
    pairs = (
        spark.range(n).withColumnRenamed("id", name)
        .withColumn("__a__", F.col(name) % m + 1)
        .withColumn("__b__", (F.col("__a__") - 1 + step) % m + 1)
    )
    left = ranked.withColumnRenamed("__pos__", "__a__")
    right = ranked.select(
        F.col("__pos__").alias("__b__"), *[col(c).cast("double").alias(f"{c}__other") for c in numeric]
    )
    u = hash_unit(order_hash(seed, [name]))
    joined = pairs.join(left, "__a__").join(right, "__b__").withColumn("__u__", u)

    def value(c: str) -> Column:
        if c not in set(numeric):
            return col(c)
        x = col(c).cast("double")
        return (x + F.col("__u__") * (col(f"{c}__other") - x)).alias(c)

    return joined.select(F.col(name), *[value(c) for c in df.columns])


__all__ = [
    "accept_top", "admit", "augment_until", "critic_score", "fit_critic",
    "interpolate", "merge_augmented", "need_per_label", "request_rows", "request_size",
]
