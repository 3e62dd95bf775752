"""Projections and row filters on flow tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkit.functions import bad_value, col, order_hash, parse_number, split_sources
from flowkit.operators.ranking import hash_rank
from flowkit.spec import DatasetSpec

TECH_COLUMNS = ("__rowid__", "__subset__", "_key_")
# Fixed values.
LABEL_CANDIDATES = ("label", "y", "target", "class", "Label")


# ---- projections ----------------------------------------------------------------------------

def select_features(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Known features in spec order plus the label.

    Absent features are skipped, or an error where the spec says so.
    """
    missing = [f for f in spec.features if f not in df.columns]
    if missing and spec.require_all_features:
        raise ValueError(f"missing features: {missing}")
    present = [f for f in spec.features if f in df.columns]
    return df.select(*[col(f) for f in present], col(spec.label))


def coerce_types(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Continuous to float, categorical and binary to int; tokens that do not parse become null."""
    integers = (set(spec.cat) - set(spec.onehot)) | set(spec.binary)

    def coerced(name: str) -> Column:
        number = parse_number(col(name))
        if name in integers:
            whole = number.try_cast("int")
            return F.when(whole == number, whole).alias(name)
        if name in spec.cont:
            return number.cast("float").alias(name)
        return col(name)

    return df.select(*[coerced(c) for c in df.columns])


def strip_label(df: DataFrame, label: str = "Label") -> DataFrame:
    """Trim the label text; a missing label stays missing."""
    return df.withColumn(label, F.trim(col(label).cast("string")))


def align_schema(df: DataFrame, fields: T.StructType) -> DataFrame:
    """Exactly these fields in this order, absent ones as null."""
    return df.select(*[
        (col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ])


def map_label(
    df: DataFrame, source: str, mapping: dict[str, Sequence[str]], default: str,
    target: str = "Label",
) -> DataFrame:
    """Raw attack name to class by a fixed mapping; names not listed get the default."""
    branches = [F.when(col(source).isin(*names), F.lit(cls)) for cls, names in mapping.items()]
    return df.withColumn(target, F.coalesce(*branches, F.lit(default)))


def unmapped_names(
    df: DataFrame, source: str, mapping: dict[str, Sequence[str]], known: Iterable[str] = ()
) -> DataFrame:
    """Strict mode of `map_label`: names that fall through to the default, with counts."""
    listed = [n for names in mapping.values() for n in names] + list(known)
    return df.where(~col(source).isin(*listed)).groupBy(col(source)).agg(
        F.count("*").alias("rows")
    )


def tag(df: DataFrame, name: str, *parts: str | Column) -> DataFrame:
    """Provenance column; several parts are joined by ':'."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return df.withColumn(name, cols[0] if len(cols) == 1 else F.concat_ws(":", *cols))


def add_row_id(
    df: DataFrame, label: str, ids: Sequence[str], seed: int = 0, name: str = "__rowid__"
) -> DataFrame:
    """Dense id from 0 within each label; the same for any partitioning."""
    return hash_rank(df, [label], ids, seed, name).withColumn(name, col(name) - 1)


def drop_tech_cols(df: DataFrame, names: Sequence[str] = TECH_COLUMNS) -> DataFrame:
    return df.drop(*names)


def detect_label_column(
    columns: Sequence[str], explicit: str | None = None, preferred: str | None = None
) -> str:
    """Explicit name, else preferred, else a usual candidate, else the last non-provenance column."""
    if explicit is not None:
        if explicit not in columns:
            raise ValueError(f"label column not found: {explicit}")
        return explicit
    choices = [c for c in (preferred, *LABEL_CANDIDATES) if c in columns]
    others = [c for c in columns if c != "__attack__"]
    return (choices or others[-1:] or list(columns)[-1:])[0]


def reorder(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Original feature order and label, existing columns only."""
    return df.select(*[col(c) for c in (*spec.features, spec.label) if c in df.columns])


def feature_matrix(df: DataFrame, spec: DatasetSpec, name: str = "features") -> DataFrame:
    """All model inputs as one array in `cat + binary + cont` order."""
    return df.withColumn(
        name, F.array(*[col(c).cast("double") for c in spec.ordered_features])
    )


def feature_positions(spec: DatasetSpec) -> dict[str, list[int]]:
    place = {n: i for i, n in enumerate(spec.ordered_features)}
    return {
        "cat": [place[c] for c in spec.cat],
        "binary": [place[c] for c in spec.binary],
        "cont": [place[c] for c in spec.cont],
    }


def relabel_selected(df: DataFrame, attack: str | Column, name: str = "__attack__") -> DataFrame:
    return df.withColumn(name, F.lit(attack) if isinstance(attack, str) else attack)


# ---- filters --------------------------------------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _missing_or_inf(df: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [bad_value(f.name, f.dataType) for f in df.schema])


def drop_missing_inf(df: DataFrame) -> DataFrame:
    """Drop rows with a null, NaN or infinite value in any column."""
    return df.where(~_missing_or_inf(df))


def has_missing_inf(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max(_missing_or_inf(df)), F.lit(False)).alias("has_missing_inf"))


def _not_negative(df: DataFrame) -> Column:
    tests = []
    for f in df.schema:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            tests.append((col(f.name) >= 0) & ~F.isnan(col(f.name)))
        elif isinstance(f.dataType, T.NumericType):
            tests.append(col(f.name) >= 0)
    # a null fails the test, like every other value that is not provably >= 0
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def _usable(df: DataFrame) -> Column:
    """Not missing, not infinite, not negative, in one comparison or two per column.

    NaN sorts above infinity, and a null fails the test like any other condition. The optimizer
    copies the typed expressions into this filter, so it has to stay small.
    """
    tests = []
    for f in df.schema:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            tests.append((col(f.name) >= 0) & (col(f.name) < F.lit(float("inf"))))
        elif isinstance(f.dataType, T.NumericType):
            tests.append(col(f.name) >= 0)
        else:
            tests.append(col(f.name).isNotNull())
    return reduce(lambda a, b: a & b, tests)


def drop_negative_rows(df: DataFrame) -> DataFrame:
    """Keep rows whose numeric columns are all >= 0."""
    return df.where(_not_negative(df))


def drop_zero_heavy(
    df: DataFrame, columns: Sequence[str], frac: float = 0.5, count: int | None = None
) -> DataFrame:
    """Keep rows with fewer zeros among `columns` than the threshold."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    limit = int(len(present) * frac) if count is None else count
    zeros = reduce(
        lambda a, b: a + b, [F.when(col(c) == 0, 1).otherwise(0) for c in present]
    )
    return df.where(zeros < limit)


def resolve_labels(
    known: Sequence[str], labels: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> list[str]:
    """All known or the listed labels, less the excluded ones."""
    unknown = [x for x in labels or () if x not in known]
    if unknown:
        raise ValueError(f"unknown labels: {unknown}")
    chosen = [x for x in (labels or known) if x not in set(exclude)]
    if not chosen:
        raise ValueError("no labels left")
    return chosen


def filter_labels(
    df: DataFrame, label: str, known: Sequence[str], labels: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    return df.where(col(label).isin(*resolve_labels(known, labels, exclude)))


def rows_of_source(
    df: DataFrame, attack: str, used_keys: DataFrame | None = None,
    source: str = "__attack__", key: str = "_key_",
) -> DataFrame:
    """Rows whose source list has this exact name, less the keys already used."""
    rows = df.where(F.array_contains(split_sources(col(source)), attack))
    return rows if used_keys is None else rows.join(used_keys.select(key), key, "left_anti")


def filter_sources(df: DataFrame, wanted: Sequence[str], source: str = "__attack__") -> DataFrame:
    return df.where(col(source).isin(*wanted))


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame | None:
    """The table, or nothing when it lacks a needed column."""
    return df if set(needed) <= set(df.columns) else None


def exclude_models(
    df: DataFrame, exclude: Sequence[str] = (), prefer: str = "histgbm", model: str = "model"
) -> DataFrame:
    """Drop excluded models and the non-preferred of the two interchangeable boosters."""
    pair = {"gbm", "histgbm"}
    if prefer not in pair:
        raise ValueError(f"prefer must be one of {sorted(pair)}")
    return df.where(~col(model).isin(*exclude, *(pair - {prefer})))


def drop_repeated_headers(df: DataFrame, label: str = "Label") -> DataFrame:
    """Drop header lines that got in as data; rows with a missing label stay."""
    return df.where(F.coalesce(F.trim(col(label)) != F.lit("Label"), F.lit(True)))


# ---- the cleaning chain and its report ------------------------------------------------------

def clean_rows(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Select, coerce, normalise labels, drop header lines and bad or negative rows.

    Row-wise only; one narrow stage. `cleaning_report` counts what it drops.
    """
    typed = strip_label(coerce_types(select_features(df, spec), spec), spec.label)
    return typed.where((col(spec.label) != "Label") & _usable(typed))


def cleaned_groups(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Distinct rows that cleaning keeps, with `__fate__` kept and their number `__c__`; rows that it
    drops only as one row per fate (header, bad, negative)."""
    typed = strip_label(coerce_types(select_features(df, spec), spec), spec.label)
    header = F.coalesce(col(spec.label) == "Label", F.lit(False))
    bad, negative = _missing_or_inf(typed), ~_not_negative(typed)
    fate = (
        F.when(header, "header").when(bad, "bad").when(negative, "negative").otherwise("kept")
    )
    # kept rows are grouped by content; dropped ones only by their fate
    content = [F.when(F.col("__fate__") == "kept", col(c)).alias(c) for c in typed.columns]
    return typed.withColumn("__fate__", fate).groupBy("__fate__", *content).agg(
        F.count("*").alias("__c__")
    )


def cleaning_report(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row: rows read, dropped as header / bad / negative / duplicate, and left."""
    return groups_report(cleaned_groups(df, spec), spec)


def groups_report(groups: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The cleaning report of `cleaned_groups`."""
    def rows(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("__fate__") == name, F.col("__c__"))), F.lit(0))

    kept = F.count_if(F.col("__fate__") == "kept")
    return groups.agg(
        F.coalesce(F.sum("__c__"), F.lit(0)).alias("rows_read"),
        rows("header").alias("header_rows"),
        rows("bad").alias("bad_rows"),
        rows("negative").alias("negative_rows"),
        (rows("kept") - kept).alias("duplicate_rows"),
        F.count_distinct(F.when(F.col("__fate__") == "kept", col(spec.label))).alias("labels"),
        kept.alias("rows_left"),
    )


def with_row_key(df: DataFrame, cols: Sequence[str], name: str = "_key_") -> DataFrame:
    """A 128-bit key of the columns that stands for their content, nulls included."""
    return df.withColumn(name, order_hash("row", cols))
