"""De-duplication, set operations and the joins between row sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.functions import col, row_key, split_sources


def dedup(df: DataFrame) -> DataFrame:
    """Distinct full rows. The label is part of the row, so this equals per-label distinct."""
    return df.dropDuplicates()


def count_duplicates(df: DataFrame) -> DataFrame:
    """One row: all rows, distinct rows, repeats, and whether there are any."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("__c__"))
    total = F.coalesce(F.sum("__c__"), F.lit(0))
    return groups.agg(
        total.alias("rows"), F.count("*").alias("distinct_rows"),
        (total - F.count("*")).alias("duplicates"),
        (total > F.count("*")).alias("has_duplicates"),
    )


def dedup_verified(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows, and a one-row report of the counts before and after."""
    out = dedup(df)
    before = count_duplicates(df).select(
        F.col("rows").alias("before"), F.col("duplicates").alias("removed"),
    )
    after = count_duplicates(out).select(
        F.col("rows").alias("after"), F.col("duplicates").alias("left"),
    )
    report = before.select(
        "before", "removed",
        after.select("after").scalar().alias("after"), after.select("left").scalar().alias("left"),
    )
    return out, report


def _first_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """The row that is smallest in `order` per key, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in set(keys)]
    ordering = F.struct(*[col(o) if isinstance(o, str) else o for o in order])
    first = F.min_by(F.struct(*[col(c) for c in rest]), ordering)
    return (
        df.groupBy(*[col(k) for k in keys]).agg(first.alias("__first__"))
        .select(
            *[col(c) if c in set(keys) else F.col("__first__").getField(c).alias(c)
              for c in df.columns]
        )
    )


def dedup_ignoring(
    df: DataFrame, tech: Sequence[str] = ("__rowid__", "__subset__"), order: str = "__rowid__"
) -> DataFrame:
    """Distinct on all but the technical columns, which come from the first row."""
    return _first_by(df, [c for c in df.columns if c not in set(tech)], [order])


def dedup_by_features(
    df: DataFrame, features: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Distinct on the features only; the first row in `order` gives the rest."""
    return _first_by(df, features, order)


def merge_sources(
    df: DataFrame, features: Sequence[str], order: Sequence[str | Column],
    label: str = "Label", source: str = "__attack__",
) -> DataFrame:
    """One row per feature tuple: first label, all source names sorted and joined by '|'.

    Rows with a null feature belong to no group and are left out.
    """
    ordering = F.struct(*[col(o) if isinstance(o, str) else o for o in order])
    present = reduce(lambda a, b: a & b, [col(f).isNotNull() for f in features])
    return (
        df.where(present).groupBy(*[col(f) for f in features])
        .agg(
            F.min_by(col(label), ordering).alias(label),
            F.array_join(F.sort_array(F.collect_set(col(source))), "|").alias(source),
        )
    )


def exclude_known(df: DataFrame, base: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose feature tuple is not in `base`.

    The shuffle and sort use one 64-bit key; the columns themselves decide equality.
    """
    known = base.select(*[col(f) for f in features]).distinct()
    known = known.select(
        row_key(features).alias("__k__"), F.struct(*[col(f) for f in features]).alias("__f__")
    )
    keyed = df.withColumn("__k__", row_key(features))
    same = reduce(
        lambda a, b: a & b, [keyed[f"`{f}`"] == known["__f__"][f] for f in features]
    )
    return keyed.join(known, (keyed["__k__"] == known["__k__"]) & same, "left_anti").drop("__k__")


def exclude_known_multi(
    df: DataFrame, bases: Sequence[DataFrame], features: Sequence[str]
) -> DataFrame:
    """`exclude_known` against several tables: train, test, rows accepted before."""
    parts = [b.select(*[col(f) for f in features]) for b in bases]
    return exclude_known(df, reduce(DataFrame.unionByName, parts), features)


def union_aligned(parts: Sequence[DataFrame]) -> DataFrame:
    """Union over the sorted union of columns, gaps as null."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.select(*[col(c) for c in sorted(merged.columns)])


def union_train(train: DataFrame, extra: DataFrame) -> DataFrame:
    """Train rows plus hardening rows; only columns known to train are kept."""
    return train.unionByName(
        extra.select(*[col(c) for c in train.columns if c in extra.columns]),
        allowMissingColumns=True,
    )


def source_counts_per_key(
    df: DataFrame, key: str = "_key_", source: str = "__attack__"
) -> DataFrame:
    """How many (row, source) pairs each key has."""
    return df.groupBy(col(key)).agg(
        F.sum(F.size(split_sources(col(source)))).cast("bigint").alias("sources")
    )


def split_unique_overlap(
    df: DataFrame, key: str = "_key_", source: str = "__attack__"
) -> tuple[DataFrame, DataFrame]:
    """Rows whose key occurs once over the exploded sources, and the rows of the other keys."""
    counted = df.join(source_counts_per_key(df, key, source), key)
    unique = F.col("sources") == 1
    return (
        counted.where(unique).select(*df.columns), counted.where(~unique).select(*df.columns)
    )


def select_back(df: DataFrame, picked: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Original rows of a selection of ids."""
    return df.join(picked.select(*[col(i) for i in ids]), list(ids), "left_semi")


def align_by_id(
    plain: DataFrame, perturbed: DataFrame, ids: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Pair plain and perturbed samples; unpaired ones on either side fall away.

    Both sides grow with the samples, however small their files look to the optimizer before they
    are exploded per model, so neither is sent to the driver and broadcast.
    """
    return plain.join(perturbed.hint("merge"), list(ids))


def alignment_counts(plain: DataFrame, perturbed: DataFrame) -> DataFrame:
    """One row: sample counts of both sides and whether they differ."""
    n_plain, n_pert = plain.agg(F.count("*").alias("n_plain")), perturbed.agg(F.count("*").alias("n"))
    return n_plain.select("n_plain", n_pert.scalar().alias("n_perturbed")).withColumn(
        "differs", F.col("n_plain") != F.col("n_perturbed")
    )
