"""Exact per-group selection that never gathers a group in one task.

Each function first builds a small threshold table from counts, then applies it to the rows in a
map-only pass. A group may hold any share of the data: counts combine before the shuffle, and only
a thin band of keys around the threshold is ever sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.functions import col, order_hash
from flowkit.staging import bounded, join_groups, lookup, stage

Quota = int | Column | Callable[[Column], Column] | DataFrame

HEX_STEP = 3  # a refinement splits a bucket into 4096
HISTOGRAM_ROWS = 1_000_000  # largest (group, bucket) count table that is kept as a literal
BAND_ROWS = 5_000_000  # most rows (keys only) that one task is asked to sort
SKETCH_FROM = 400_000  # rows from which a sketch is cheaper than counting all distinct values
SKETCH_CELLS = 256
SKETCH_ACCURACY = 10_000
MAX_ROUNDS = 6
FEW_ROWS = 10_000  # first rows that one task may hold


def _cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def _with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key when there is no grouping, so that both cases share one plan."""
    if keys:
        return df, list(keys)
    return df.withColumn("__all__", F.lit(0)), ["__all__"]


def _join_groups(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Bring the columns of a table (keys, ...) to the rows.

    Without grouping the table has at most one row per wanted statistic, so its values become
    literals and no join is planned.
    """
    if keys != ["__all__"]:
        return lookup(df, table, keys, how)
    table = table.drop("__all__")
    rows = table.collect()
    kinds = {f.name: f.dataType for f in table.schema}
    if not rows:
        empty = df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
        return empty if how == "left" else empty.where(F.lit(False))
    values = [F.struct(*[F.lit(r[c]).cast(k).alias(c) for c, k in kinds.items()]) for r in rows]
    if len(values) == 1:
        return df.withColumns({c: F.lit(rows[0][c]).cast(k) for c, k in kinds.items()})
    return df.withColumn("__g__", F.explode(F.array(*values))).select(*_cols(df.columns), "__g__.*")


def _attach_quota(groups: DataFrame, keys: list[str], quota: Quota) -> DataFrame:
    """Add `__q__` to a table that has the group size in `__n__`."""
    if isinstance(quota, DataFrame):
        if not set(keys) <= set(quota.columns):
            quota = quota.withColumn("__all__", F.lit(0))
        small = quota.select(*_cols(keys), F.col("quota").cast("bigint").alias("__q__"))
        return lookup(groups, small, keys)
    value = quota(F.col("__n__")) if callable(quota) and not isinstance(quota, Column) else quota
    value = F.lit(value) if isinstance(value, int) else value
    return groups.withColumn("__q__", value.cast("bigint"))


def hash_thresholds(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, quota: Quota
) -> DataFrame:
    """Per group its size and the largest hash inside the quota: (keys, `__n__`, `__cut__`).

    `ids` must identify a row. `quota` is a number, a function of the group size, or a table
    (keys, quota). A group without any selected row has a null `__cut__`.

    Two narrow passes: counts per (group, hash bucket), then a sort of the one bucket per group
    that the quota ends in. A bucket that is still too large for one task is counted again by
    longer hash prefixes first.
    """
    df, keys = _with_key(df, keys)
    narrow = df.select(*_cols(keys), order_hash(seed, ids).alias("__h__"))
    histogram = _prefix_histogram(narrow, keys, HEX_STEP)
    sizes = histogram.groupBy(*_cols(keys)).agg(F.max("__n__").alias("__n__"))
    cut = _cut_bucket(_attach_quota(histogram, keys, quota), keys)
    digits = HEX_STEP
    while digits < 30 and _largest(cut, "__c__") > BAND_ROWS:
        band = _in_bucket(narrow, cut, keys, digits)
        digits += HEX_STEP
        finer = _prefix_histogram(band, keys, digits)
        needs = cut.select(*_cols(keys), F.col("__need__").alias("__q__"))
        cut = _cut_bucket(join_groups(finer, needs, keys), keys)
    order = Window.partitionBy(*_cols(keys)).orderBy("__h__")
    inside = (
        _in_bucket(narrow, cut, keys, digits)
        .withColumn("__rn__", F.row_number().over(order))
        .where(F.col("__rn__") <= F.col("__need__"))
        .groupBy(*_cols(keys)).agg(F.max("__h__").alias("__cut__"))
    )
    return join_groups(sizes, bounded(inside)[0], keys, "left").select(*_cols(keys), "__n__", "__cut__")


def _prefix_histogram(narrow: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """Rows per hash prefix, rows before it, and group size."""
    counts = narrow.groupBy(*_cols(keys), F.substring("__h__", 1, digits).alias("__b__")).agg(
        F.count("*").alias("__c__")
    )
    by_key = Window.partitionBy(*_cols(keys))
    running = by_key.orderBy("__b__").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bounded(counts, HISTOGRAM_ROWS)[0]
        .withColumn("__before__", F.coalesce(F.sum("__c__").over(running), F.lit(0)))
        .withColumn("__n__", F.sum("__c__").over(by_key))
    )


def _cut_bucket(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket each quota ends in: (keys, prefix, rows in it, rows still needed from it)."""
    touched = histogram.where(
        (F.col("__before__") < F.col("__q__")) & (F.col("__q__") > 0)
    )
    last = F.max_by(F.struct("__b__", "__c__", "__before__"), F.col("__b__"))
    cut = touched.groupBy(*_cols(keys)).agg(last.alias("__l__"), F.max("__q__").alias("__q__"))
    return bounded(cut.select(
        *_cols(keys), "__l__.__b__", "__l__.__c__", (F.col("__q__") - F.col("__l__.__before__")).alias("__need__")
    ))[0]


def _in_bucket(narrow: DataFrame, cut: DataFrame, keys: list[str], digits: int) -> DataFrame:
    prefixed = narrow.withColumn("__b__", F.substring("__h__", 1, digits))
    return lookup(prefixed, cut.drop("__c__"), [*keys, "__b__"]).drop("__b__")


def _largest(table: DataFrame, column: str) -> int:
    return table.agg(F.max(column).alias("m")).first()["m"] or 0


def hash_flag(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, quota: Quota,
    flag: str = "selected", size: str | None = None,
) -> DataFrame:
    """Mark the first `quota` rows of each group in seeded hash order.

    With `size`, the number of rows of the group comes along.
    """
    keyed, names = _with_key(df, keys)
    joined = _join_groups(keyed, hash_thresholds(df, keys, ids, seed, quota), names, how="left")
    inside = F.coalesce(order_hash(seed, ids) <= F.col("__cut__"), F.lit(False)).alias(flag)
    extra = [F.col("__n__").alias(size)] if size else []
    return joined.select(*_cols(df.columns), inside, *extra)


def hash_take(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, quota: Quota
) -> DataFrame:
    """Keep the first `quota` rows of each group in seeded hash order."""
    keyed, names = _with_key(df, keys)
    cuts = hash_thresholds(df, keys, ids, seed, quota).where(F.col("__cut__").isNotNull())
    joined = _join_groups(keyed, cuts.drop("__n__"), names)
    return joined.where(order_hash(seed, ids) <= F.col("__cut__")).select(*_cols(df.columns))


def hash_rank(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, name: str = "position"
) -> DataFrame:
    """Dense position (from 1) of every row within its group in seeded hash order.

    Rows are sorted per (group, hash bucket); the bucket offsets come from counts, so a group is
    spread over as many tasks as it has buckets, and buckets get finer as the data grows.
    """
    keyed, names = _with_key(df, keys)
    keyed = keyed.withColumn("__h__", order_hash(seed, ids))
    digits = HEX_STEP
    histogram = _prefix_histogram(keyed, names, digits)
    while digits < HEX_STEP + 2 and _largest(histogram, "__c__") > BAND_ROWS:
        digits += 1
        histogram = _prefix_histogram(keyed, names, digits)
    offsets = histogram.select(*_cols(names), "__b__", "__before__")
    within = Window.partitionBy(*_cols(names), "__b__").orderBy("__h__", *_cols(ids))
    keyed = keyed.withColumn("__b__", F.substring("__h__", 1, digits))
    ranked = lookup(keyed, offsets, [*names, "__b__"], max_rows=HISTOGRAM_ROWS)
    return ranked.withColumn(
        name, (F.row_number().over(within) + F.col("__before__")).cast("bigint")
    ).select(*_cols(df.columns), name)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str,
    ranks: dict[str, Callable[[Column], Column] | int] | None = None,
    quota: DataFrame | None = None,
) -> DataFrame:
    """Exact k-th smallest values per group: (keys, `__n__`, one struct per entry of `ranks`).

    A struct has the value `v`, the number of rows `before` it and the `same` rows, and the value
    at the `next` rank.

    While a bracket holds more rows than one task should sort, a mergeable quantile sketch of it
    narrows it down, all groups at once. Then one counting pass settles the rank among the
    distinct values inside, so equal values cost nothing. With `quota` (keys, quota) the single
    statistic `kth` is the value at that rank, cut to the group size.
    """
    grouped = bool(keys)
    df, keys = _with_key(df, keys)
    narrow = df.where(col(value).isNotNull()).select(
        *_cols(keys), col(value).cast("double").alias("__v__")
    )
    groups = bounded(narrow.groupBy(*_cols(keys)).agg(F.count("*").alias("__n__")))[0]
    if quota is not None:
        groups = _attach_quota(groups, keys, quota)
        ranks = {"kth": lambda n: F.least(n, F.col("__q__"))}
    n = F.col("__n__")
    wanted = F.array(*[
        F.struct(F.lit(name).alias("__t__"), (F.lit(r) if isinstance(r, int) else r(n)).cast("bigint").alias("__r__"))
        for name, r in ranks.items()
    ])
    nothing = F.lit(None).cast("double")
    targets = bounded(
        groups.select(*_cols(keys), "__n__", F.explode(wanted).alias("__w__"))
        .select(*_cols(keys), "__n__", "__w__.__t__", "__w__.__r__").where(F.col("__r__").between(1, n))
        .select("*", nothing.alias("__lo__"), nothing.alias("__hi__"), n.alias("__m__"))
    )[0]
    for turn in range(MAX_ROUNDS):
        load = targets.agg(F.max("__m__").alias("top"), F.sum("__m__").alias("all")).first()
        if (load["top"] or 0) <= BAND_ROWS and (turn or (load["all"] or 0) <= SKETCH_FROM):
            break
        targets = _narrow_brackets(narrow, targets, keys)
    by = [*_cols(keys), F.col("__n__"), F.col("__t__"), F.col("__r__")]
    counted = (
        _join_groups(narrow, targets, keys).where(_not_above())
        .groupBy(*by, F.when(_not_below(), F.col("__v__")).alias("__v__"))
        .agg(F.count("*").alias("__c__"))
    )
    upto = Window.partitionBy(*_cols(keys), "__t__").orderBy(F.col("__v__").asc_nulls_first())
    found = F.struct(
        F.col("__v__").alias("v"), (F.col("__upto__") - F.col("__c__")).alias("before"),
        F.col("__c__").alias("same"),
    )

    def at(name: str, rank: Column) -> Column:
        return F.when((F.col("__t__") == name) & (F.col("__upto__") >= rank), F.col("__v__"))

    settled = (
        counted.withColumn("__upto__", F.sum("__c__").over(upto)).where(F.col("__v__").isNotNull())
        .groupBy(*_cols(keys), "__n__")
        .agg(*[
            F.struct(
                F.min_by(found, at(name, F.col("__r__"))).alias("f"),
                F.min(at(name, F.least(F.col("__r__") + 1, F.col("__n__")))).alias("next"),
            ).alias(name)
            for name in ranks
        ])
    )
    out = settled.select(
        *_cols(keys), "__n__",
        *[F.struct(f"{x}.f.v", f"{x}.f.before", f"{x}.f.same", f"{x}.next").alias(x) for x in ranks],
    )
    return out if grouped else out.drop("__all__")


def _not_below() -> Column:
    return F.col("__lo__").isNull() | (F.col("__v__") >= F.col("__lo__"))


def _not_above() -> Column:
    return F.col("__hi__").isNull() | (F.col("__v__") <= F.col("__hi__"))


def _narrow_brackets(narrow: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """New bounds for each wanted rank from a sketch of the rows between the old ones."""
    grid = [i / SKETCH_CELLS for i in range(SKETCH_CELLS + 1)]
    by = [*_cols(keys), F.col("__n__"), F.col("__t__"), F.col("__r__"), F.col("__lo__"), F.col("__hi__")]
    inside = F.when(_not_below(), F.col("__v__"))
    sketch = (
        _join_groups(narrow, targets, keys).where(_not_above()).groupBy(*by)
        .agg(
            F.count("*").alias("__upto__"), F.count(inside).alias("__m__"),
            F.percentile_approx(inside, grid, SKETCH_ACCURACY).alias("__g__"),
        )
    )
    # one cell of slack on each side is far wider than the error of the sketch
    below = F.col("__upto__") - F.col("__m__")
    low = F.floor((F.col("__r__") - below) * SKETCH_CELLS / F.col("__m__")).cast("int") - 1
    high = F.ceil((F.col("__r__") + 1 - below) * SKETCH_CELLS / F.col("__m__")).cast("int") + 1
    lo = F.when(low >= 1, F.get("__g__", low)).otherwise(F.col("__lo__"))
    hi = F.when(high < SKETCH_CELLS, F.get("__g__", high)).otherwise(F.col("__hi__"))
    # a bracket around one value is settled, however many rows have it
    width = F.when(lo == hi, F.lit(0)).otherwise(
        F.ceil(F.col("__m__") * (high - low) / SKETCH_CELLS)
    )
    return bounded(sketch.select(
        *by[:-2], lo.alias("__lo__"), hi.alias("__hi__"), width.cast("bigint").alias("__m__")
    ))[0]


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]
) -> DataFrame:
    """Interpolated percentiles per group, one column per entry of `shares`, and `__n__`."""
    ranks = {name: (lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1) for name, p in shares.items()}
    stats = order_statistics(df, keys, value, ranks)

    def blend(name: str, p: float) -> Column:
        position = (F.col("__n__") - 1) * F.lit(p)
        part = position - F.floor(position)
        lo, hi = F.col(name)["v"], F.col(name)["next"]
        return (lo + (hi - lo) * part).alias(name)

    return stats.select(*_cols(keys), "__n__", *[blend(k, p) for k, p in shares.items()])


def smallest_thresholds(
    df: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str], seed: int, quota: DataFrame
) -> tuple[DataFrame, list[str]]:
    """Thresholds for the `quota` smallest values per group: (keys, `kth`, `__cut__`).

    Rows below `kth` are in. Of the rows equal to it those up to hash `__cut__` are in, so any
    number of equal values is split exactly; without a cut all of them are.
    """
    df, keys = _with_key(df, keys)
    if not set(keys) <= set(quota.columns):
        quota = quota.withColumn("__all__", F.lit(0))
    quota = quota.where(F.col("quota") > 0)
    narrow = df.select(*_cols(keys), _nulls_last(value).alias("__v__"), *_cols(ids))
    stats = order_statistics(narrow, keys, "__v__", quota=quota)
    needed = F.least(F.col("quota"), F.col("__n__")) - F.col("kth.before")
    kth = bounded(lookup(stats, quota, list(keys)).select(
        *_cols(keys), F.col("kth.v").alias("kth"), needed.alias("quota"),
        (needed < F.col("kth.same")).alias("__split__"),
    ))[0]
    split = kth.where("__split__")
    if split.isEmpty():
        return kth.select(*_cols(keys), "kth", F.lit(None).cast("string").alias("__cut__")), list(keys)
    ties = _join_groups(narrow, split.select(*_cols(keys), "kth"), list(keys)).where("__v__ = kth")
    cuts = hash_thresholds(ties, keys, ids, seed, split.select(*_cols(keys), "quota"))
    return join_groups(kth.select(*_cols(keys), "kth"), cuts.drop("__n__"), list(keys), "left"), list(keys)


def _nulls_last(value: str) -> Column:
    return F.coalesce(col(value).cast("double"), F.lit(float("inf")))


def take_smallest(
    df: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str], quota: int | DataFrame,
    seed: int = 42,
) -> DataFrame:
    """The `quota` rows with the smallest `value` per group; ties by seeded hash of `ids`.

    Rows without a value come last, with the infinite ones.
    """
    if isinstance(quota, int):
        keyed, names = _with_key(df, keys)
        quota = keyed.select(*_cols(names)).distinct().withColumn("quota", F.lit(quota))
    cuts, names = smallest_thresholds(df, keys, value, ids, seed, quota)
    keyed, _ = _with_key(df, keys)
    v = _nulls_last(value)
    inside = (v < F.col("kth")) | (
        (v == F.col("kth")) & (F.col("__cut__").isNull() | (order_hash(seed, ids) <= F.col("__cut__")))
    )
    return _join_groups(keyed, cuts, names).where(inside).select(*_cols(df.columns))


def first_rows(df: DataFrame, order: Sequence[str], n: int, few: int = FEW_ROWS) -> DataFrame:
    """The first `n` rows in ascending order of the columns, nulls first, in no order.

    Up to `few` rows one task can hold them (a top-n of every task). More are taken by ranges: the
    rows are written range by range, and only the range in which the n-th row lies is sorted and cut.
    """
    by = _cols(order)
    if n <= few:
        return df.orderBy(*by).limit(n)
    ranged = stage(df.repartitionByRange(*by).withColumn("__range__", F.spark_partition_id()))
    before = 0
    for r in ranged.groupBy("__range__").agg(F.count("*").alias("n")).orderBy("__range__").collect():
        if before + r["n"] >= n:
            whole = ranged.where(F.col("__range__") < r["__range__"])
            last = ranged.where(F.col("__range__") == r["__range__"]).orderBy(*by).limit(n - before)
            return whole.unionByName(last).drop("__range__")
        before += r["n"]
    return ranged.drop("__range__")
