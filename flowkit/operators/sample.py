"""Splits, capped and balanced samples. Counts are exact; the random order is a seeded hash."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.functions import bounded_quota, col, order_hash, split_sources
from flowkit.operators.dedup import source_counts_per_key
from flowkit.operators.ranking import first_rows, hash_flag, hash_rank, hash_take, take_smallest
from flowkit.staging import bounded, lookup, stage


def split_by_label(
    df: DataFrame, ids: Sequence[str], label: str = "Label", test_size: float = 0.3,
    seed: int = 42,
) -> DataFrame:
    """Add `subset`: per label `ceil(n * test_size)` test rows, the rest train.

    Labels with fewer than two rows are left out.
    """
    flagged = hash_flag(
        df, [label], ids, seed, lambda n: F.ceil(n * F.lit(test_size)), flag="__test__", size="__n__"
    )
    side = F.when(F.col("__test__"), "test").otherwise("train")
    return flagged.where(F.col("__n__") >= 2).withColumn("subset", side).drop("__test__", "__n__")


def largest_remainder(counts: DataFrame, label: str, total: Column) -> DataFrame:
    """Split `total` over labels in proportion to `n`; (label, quota), exact sum."""
    everything = Window.partitionBy(F.lit(0))
    share = F.col("n") * total / F.sum("n").over(everything)
    based = counts.withColumn("__share__", share).withColumn(
        "__base__", F.floor("__share__").cast("bigint")
    )
    missing = total.cast("bigint") - F.sum("__base__").over(everything)
    order = everything.orderBy(F.desc(F.round(F.col("__share__") - F.col("__base__"), 9)), F.asc(f"`{label}`"))
    extra = (F.row_number().over(order) <= missing).cast("bigint")
    return based.select(col(label), (F.col("__base__") + extra).alias("quota"))


def stratified_split(
    df: DataFrame, ids: Sequence[str], label: str = "Label", val_size: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add `subset`: an exact-size validation part, proportional per label."""
    counts = bounded(df.groupBy(col(label)).agg(F.count("*").alias("n")))[0]
    total = F.ceil(F.sum("n").over(Window.partitionBy(F.lit(0))) * F.lit(val_size))
    quota = largest_remainder(counts.withColumn("__t__", total), label, F.col("__t__"))
    return hash_flag(df, [label], ids, seed, quota, flag="__val__").withColumn(
        "subset", F.when(F.col("__val__"), "val").otherwise("train")
    ).drop("__val__")


def cap_per_label(
    df: DataFrame, ids: Sequence[str], tau: int, label: str = "Label", seed: int = 42
) -> DataFrame:
    """At most `tau` random rows per label; `tau <= 0` keeps all."""
    return df if tau <= 0 else hash_take(df, [label], ids, seed, tau)


def shuffle(df: DataFrame, ids: Sequence[str], seed: int = 42, name: str = "position") -> DataFrame:
    """Total random order as a dense position; sort or range-partition by it when writing."""
    return hash_rank(df, [], ids, seed, name)


def take_rows(
    df: DataFrame, n: int, ids: Sequence[str], mode: str = "first", seed: int = 42
) -> DataFrame:
    """First `n` rows in id order, or `n` random ones without replacement."""
    if mode == "random":
        return hash_take(df, [], ids, seed, n)
    return first_rows(df, ids, n)


def fallback_sample(df: DataFrame, ids: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """Stand-in test table: up to `n` random train rows."""
    return take_rows(df, n, ids, "random", seed)


def _equal_shares(keys: Sequence[str], label: str, total: Column) -> Column:
    """Equal integer quota per label; the remainder goes to the first labels in text order."""
    group = Window.partitionBy(*[col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    k = F.count("*").over(group)
    rank = F.row_number().over(group.orderBy(col(label).cast("string")))
    return (F.floor(total / k) + (rank <= total % k).cast("int")).cast("bigint")


def allocate_quotas(labels: DataFrame, total: int, label: str = "Label") -> DataFrame:
    """(label, quota) for a table of distinct labels."""
    return labels.select(col(label), _equal_shares([], label, F.lit(total)).alias("quota"))


def _label_counts(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return bounded(
        df.where(col(label).isNotNull())
        .groupBy(*[col(k) for k in keys], col(label)).agg(F.count("*").alias("avail"))
    )[0]


def balanced_sample(
    df: DataFrame, ids: Sequence[str], total: int, label: str = "Label", seed: int = 1337
) -> DataFrame:
    """Equal quotas per label, each label cut to its quota."""
    quota = allocate_quotas(_label_counts(df, label), total, label)
    return hash_take(df, [label], ids, seed, quota)


def _with_current(counts: DataFrame, current: DataFrame | None, label: str) -> DataFrame:
    if current is None:
        return counts.withColumn("cur", F.lit(0).cast("bigint"))
    return counts.join(
        current.select(col(label), F.col("rows").alias("cur")), label, "left"
    ).na.fill(0, ["cur"])


def balanced_sample_capped(
    df: DataFrame, ids: Sequence[str], total: int, cap: int,
    current: DataFrame | None = None, label: str = "Label", seed: int = 1337,
) -> DataFrame:
    """Equal quotas, but each label only up to `cap` less the rows it already has.

    `current` is (label, rows).
    """
    counts = _with_current(_label_counts(df, label), current, label)
    share = _equal_shares([], label, F.lit(total))
    quota = counts.withColumn("share", share).select(
        col(label),
        bounded_quota(F.col("share"), F.lit(cap) - F.col("cur"), F.col("avail")).alias("quota"),
    )
    return hash_take(df, [label], ids, seed, quota)


def fill_quotas(
    counts: DataFrame, keys: Sequence[str], cap: Column, need: Column, label: str = "Label"
) -> DataFrame:
    """Walk the labels in text order and take what fits: (keys, label, quota).

    `counts` has `avail` and `cur`. A label may take its rows up to the cap; a running sum tells
    how much of `need` the labels before it used.
    """
    group = Window.partitionBy(*[col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy(col(label).cast("string")).rowsBetween(Window.unboundedPreceding, -1)
    room = bounded_quota(F.col("avail"), cap - F.col("cur"))
    used = F.coalesce(F.sum("__room__").over(before), F.lit(0))
    return counts.withColumn("__room__", room).withColumn("__used__", used).select(
        *[col(k) for k in keys], col(label),
        bounded_quota(F.col("__room__"), need - F.col("__used__")).cast("bigint").alias("quota"),
    )


def fill_capped(
    df: DataFrame, ids: Sequence[str], total: int, cap: int,
    current: DataFrame | None = None, label: str = "Label", seed: int = 1337,
) -> DataFrame:
    """Fill up to `total` rows, label by label in text order, within the cap."""
    counts = _with_current(_label_counts(df, label), current, label)
    quota = fill_quotas(counts, [], F.lit(cap), F.lit(total), label)
    return hash_take(df, [label], ids, seed, quota)


def source_cap(threshold: int, labels: int) -> int:
    """Largest number of rows one label may have within one source."""
    return math.ceil(threshold / max(1, labels) * 2.0)


def balance_sources(
    df: DataFrame, threshold: int, ids: Sequence[str], label: str = "Label",
    source: str = "__attack__", key: str = "_key_", seed: int = 1337,
) -> DataFrame:
    """Up to `threshold` rows per source, balanced over labels, no key used twice.

    `df` has one row per key with its sources joined by '|'. Rows of a single source are balanced
    and filled for all sources at once, since no other source can want them. Rows of several
    sources are then given out one source at a time in name order.
    """
    rows = stage(
        df.join(source_counts_per_key(df, key, source), key)
        .select(*df.columns, F.col("sources"))
    )
    unique, overlap = rows.where("sources = 1"), rows.where("sources > 1")
    labels = rows.agg(
        (F.count_distinct(col(label)) + F.max(col(label).isNull().cast("int"))).alias("k")
    ).first()["k"] or 0
    cap = F.lit(source_cap(threshold, labels))

    by_source = Window.partitionBy(col(source))
    counts = _label_counts(unique, label, [source])
    share = _equal_shares([source], label, F.least(F.lit(threshold), F.sum("avail").over(by_source)))
    phase1 = counts.withColumn("__share__", share).withColumn(
        "cur", bounded_quota(F.col("__share__"), cap, F.col("avail"))
    )
    rest = phase1.withColumn("__need__", F.lit(threshold) - F.sum("cur").over(by_source)).withColumn(
        "avail", F.col("avail") - F.col("cur")
    )
    phase2 = fill_quotas(rest, [source], cap, F.col("__need__"), label)
    taken = bounded(
        phase1.join(phase2, [source, label])
        .select(col(source), col(label), (F.col("cur") + F.col("quota")).cast("bigint").alias("quota"))
    )[0]
    picked = [hash_take(unique, [source, label], ids, seed, taken).select(*df.columns)]

    # one small job per source that has shared rows: the number of sources, not of rows
    shared = overlap.select(F.explode(split_sources(col(source))).alias("s")).distinct()
    names = [r["s"] for r in shared.orderBy("s").collect()]
    used: list[DataFrame] = []
    for name in names:
        free = overlap.where(F.array_contains(split_sources(col(source)), name))
        if used:
            free = free.join(reduce(DataFrame.unionByName, used), key, "left_anti")
        have = taken.where(col(source) == name)
        need = threshold - (have.agg(F.sum("quota").alias("t")).first()["t"] or 0)
        if need <= 0:
            continue
        counts = _with_current(
            _label_counts(free, label), have.select(col(label), F.col("quota").alias("rows")), label
        )
        quota = fill_quotas(counts, [], cap, F.lit(need), label)
        part = stage(hash_take(free, [label], ids, seed, quota).select(*df.columns))
        used.append(part.select(key))
        picked.append(part.withColumn(source, F.lit(name)))
    return reduce(DataFrame.unionByName, picked)


def trim_to_need(df: DataFrame, ids: Sequence[str], need: int) -> DataFrame:
    """First `need` accepted rows in the order of `ids`."""
    return first_rows(df, ids, need)


def top_closest(
    df: DataFrame, n: int, ids: Sequence[str], value: str = "dist",
    selected: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """The `n` rows with the smallest value that are not selected yet."""
    rest = df if selected is None else df.join(
        selected.select(*[col(i) for i in ids]), list(ids), "left_anti"
    )
    return take_smallest(rest, [], value, ids, n, seed)


def argmin_per_group(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], value: str = "dist", seed: int = 42
) -> DataFrame:
    """Ids and value of the row with the smallest value per group; ties by seeded hash.

    First the smallest value per group, a hash aggregate; only rows that reach it are compared.
    """
    names = [col(k) for k in keys]
    least = df.groupBy(*names).agg(F.min(col(value)).alias("__min__"))
    reached = lookup(df, least, list(keys)).where(col(value) == F.col("__min__"))
    best = F.min_by(F.struct(*[col(i) for i in ids], col(value)), order_hash(seed, ids))
    return reached.groupBy(*names).agg(best.alias("__b__")).select(*names, "__b__.*")
