"""Counts, statistics and cross-tabs. Every report aggregates first and reshapes the small result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.functions import col, split_sources
from flowkit.operators.ranking import exact_percentiles

TINY_STD = 1e-6


def label_distribution(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.groupBy(col(label)).agg(F.count("*").alias("rows")).orderBy(
        F.desc("rows"), F.asc(f"`{label}`")
    )


def table_info(df: DataFrame, label: str = "Label") -> DataFrame:
    """Row count, column count and column names next to the label counts."""
    counts = df.groupBy(col(label)).agg(F.count("*").alias("label_rows"))
    total = counts.agg(F.sum("label_rows").alias("t"))
    return counts.select(
        col(label), "label_rows", total.scalar().alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit("|".join(df.columns)).alias("names"),
    )


def distribution_by_file(df: DataFrame, file: str, label: str = "Label") -> DataFrame:
    return df.groupBy(col(file), col(label)).agg(F.count("*").alias("rows"))


def distinct_values_by_file(df: DataFrame, file: str, value: str) -> DataFrame:
    """Sorted set of the values of a low-cardinality column per file.

    Distinct pairs are formed before the sets, so a large file is combined on the map side.
    """
    pairs = df.where(col(value).isNotNull()).select(col(file), col(value)).distinct()
    return pairs.groupBy(col(file)).agg(F.sort_array(F.collect_set(col(value))).alias("values"))


def cardinality(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values per column: (column, cardinality)."""
    if approx:
        wide = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in cols])
        names = [F.struct(F.lit(c).alias("column"), col(c).alias("cardinality")) for c in cols]
        return wide.select(F.explode(F.array(*names)).alias("x")).select("x.*")
    pair = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols
    ]))
    return (
        df.select(pair.alias("x")).select("x.*").distinct()
        .groupBy("column").agg(F.count("value").alias("cardinality"))
    )


def crosstab(
    df: DataFrame, row: str, column: str, values: Sequence[str] | None = None,
    weight: Column | None = None, totals: bool = True,
) -> DataFrame:
    """Row x column counts, zero-filled, with a `total` column and an `all` row.

    The rows are counted once per cell; the totals and the pivot work on the counts.
    """
    cells = df.groupBy(col(row).cast("string").alias(row), col(column).cast("string").alias("__c__")).agg(
        (F.count("*") if weight is None else F.sum(weight)).cast("bigint").alias("__n__")
    )
    if totals:
        cells = cells.withColumn(row, F.explode(F.array(col(row), F.lit("all"))))
    pivot = cells.groupBy(col(row))
    pivot = pivot.pivot("__c__", list(values)) if values is not None else pivot.pivot("__c__")
    wide = pivot.agg(F.sum("__n__")).na.fill(0)
    if not totals:
        return wide
    names = [c for c in wide.columns if c != row]
    return wide.withColumn("total", sum((col(c) for c in names), F.lit(0).cast("bigint")))


def explode_sources(df: DataFrame, source: str = "__attack__") -> DataFrame:
    return df.withColumn(source, F.explode(split_sources(col(source))))


def crosstab_exploded(
    df: DataFrame, column: str = "Label", source: str = "__attack__",
    values: Sequence[str] | None = None, totals: bool = True,
) -> DataFrame:
    """Cross-tab after splitting multi-valued sources.

    Rows are counted per (source list, column) first; only those few groups are exploded.
    """
    groups = df.groupBy(col(source), col(column)).agg(F.count("*").alias("__w__"))
    return crosstab(
        explode_sources(groups, source), source, column, values, weight=F.col("__w__"),
        totals=totals,
    )


def source_overlap(
    df: DataFrame, values: Sequence[str], source: str = "__attack__"
) -> DataFrame:
    """Per source `a`: rows that also carry `b`, as columns `dup-<b>`.

    Works on counts per source list, so no pairs of rows are formed.
    """
    lists = df.groupBy(col(source)).agg(F.count("*").alias("__w__"))
    names = F.split(col(source), "\\|")
    per_source = lists.select(F.explode(names).alias(source), names.alias("__all__"), "__w__")

    def carries(b: str) -> Column:
        both = F.array_contains("__all__", b) & (col(source) != b)
        return F.sum(F.when(both, F.col("__w__")).otherwise(0)).cast("bigint").alias(f"dup-{b}")

    return per_source.groupBy(col(source)).agg(*[carries(b) for b in values])


def pre_post_counts(
    df: DataFrame, features: Sequence[str], source: str = "__attack__", label: str = "Label",
) -> DataFrame:
    """Per source and label: rows before and after distinct on the features within the source."""
    groups = df.groupBy(col(source), col(label), *[col(f) for f in features]).agg(
        F.count("*").alias("__c__")
    )
    return groups.groupBy(col(source), col(label)).agg(
        F.sum("__c__").alias("before"), F.count("*").alias("after")
    )


def continuous_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mean, std): population deviation, tiny ones replaced by 1."""
    wide = df.agg(*[
        e for c in cols
        for e in (F.avg(col(c)).alias(f"{c}__mean"), F.stddev_pop(col(c)).alias(f"{c}__std"))
    ])
    rows = [
        F.struct(
            F.lit(c).alias("column"), col(f"{c}__mean").alias("mean"),
            F.when(col(f"{c}__std") < TINY_STD, 1.0).otherwise(col(f"{c}__std")).alias("std"),
        )
        for c in cols
    ]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def global_clip(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: smallest and largest value over the whole feature matrix."""
    def extreme(over, of):
        parts = [of(col(c).cast("double")) for c in cols]
        return parts[0] if len(parts) == 1 else over(*parts)

    return df.agg(
        extreme(F.least, F.min).alias("clip_min"), extreme(F.greatest, F.max).alias("clip_max")
    )


def summary_counts(counts: DataFrame, order: Sequence[str], top: int = 15) -> DataFrame:
    """The first `top` rows of a count table and how many more there are."""
    more = counts.agg(F.greatest(F.count("*") - F.lit(top), F.lit(0)).alias("m"))
    return counts.orderBy(*[col(o) for o in order]).limit(top).withColumn(
        "more", more.scalar().cast("bigint")
    )


def distance_report(
    df: DataFrame, value: str, keys: Sequence[str] = (),
    shares: dict[str, float] | None = None,
) -> DataFrame:
    """min, mean, percentiles and max of a distance or score column."""
    shares = shares or {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    v = col(value).cast("double")
    exprs = [F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max")]
    percentiles = exact_percentiles(df, keys, value, shares).drop("__n__")
    if keys:
        return df.groupBy(*[col(k) for k in keys]).agg(*exprs).join(percentiles, list(keys))
    simple = df.agg(*exprs)
    return percentiles.select(
        *[simple.select(c).scalar().alias(c) for c in ("min", "mean", "max")],
        *[F.col(s) for s in shares],
    )
