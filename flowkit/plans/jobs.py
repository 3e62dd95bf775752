"""Composite jobs: what a user calls. Each one wires operators into one lazy plan per output."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.functions import argmax_class, col
from flowkit.operators import (
    augment, clean, compress, dedup, encode, report, sample, score, train,
)
from flowkit.sources import tables
from flowkit.spec import DatasetSpec
from flowkit.staging import stage


@dataclass(frozen=True)
class Cleaned:
    rows: DataFrame
    report: DataFrame


def clean_flows(
    spark: SparkSession, folder: str, spec: DatasetSpec, out: str | None = None
) -> Cleaned:
    """CSV folder with drifting headers to distinct clean rows, written by label."""
    headers = tables.read_header(spark, tables.list_inputs(spark, folder))
    voted = tables.majority_schema(headers).first()["header"]
    wanted = [c for c in voted if c in (*spec.features, spec.label)]
    return clean_table(tables.read_flows(spark, headers, wanted).drop("__file__"), spec, out)


def clean_table(df: DataFrame, spec: DatasetSpec, out: str | None = None) -> Cleaned:
    """The cleaning chain on a table that is already loaded.

    With `out`, the input is scanned and grouped once: the distinct rows are written with their
    numbers, and both the table by label and the report come from them.
    """
    if out is None:
        return Cleaned(dedup.dedup(clean.clean_rows(df, spec)), clean.cleaning_report(df, spec))
    groups = stage(clean.cleaned_groups(df, spec))
    tables.write_by_label(groups.where("__fate__ = 'kept'").drop("__fate__", "__c__"), out, spec.label)
    rows = df.sparkSession.read.parquet(out).drop("label_safe")
    return Cleaned(rows, clean.groups_report(groups, spec))


def clean_headerless(
    spark: SparkSession, path: str, spec: DatasetSpec, ids: Sequence[str] | None = None,
    attack: str = "attack",
) -> tuple[DataFrame, DataFrame, encode.Encoders]:
    """Headerless text to (split rows, cardinalities, encoders fitted on train)."""
    raw = tables.read_headerless(spark, path, spec.raw_columns, (*spec.binary, *spec.cont))
    labelled = clean.map_label(raw, attack, spec.label_map, spec.default_label, spec.label)
    rows = dedup.dedup(clean.drop_missing_inf(clean.select_features(labelled, spec)))
    rows = stage(clean.filter_labels(rows, spec.label, spec.class_names))
    keyed = rows if ids else clean.with_row_key(rows, rows.columns)
    parts = sample.split_by_label(keyed, ids or ["_key_"], spec.label).drop("_key_")
    return (
        parts, report.cardinality(rows, spec.cat),
        encode.fit_encoders(parts.where("subset = 'train'").drop("subset"), spec),
    )


def split(
    df: DataFrame, ids: Sequence[str], label: str = "Label", test_size: float = 0.3,
    seed: int = 42, labels: Sequence[str] | None = None, out: str | None = None,
) -> DataFrame:
    """Per-label train/test split of the chosen labels, written by subset and label."""
    rows = df if labels is None else df.where(col(label).isin(*labels))
    parts = sample.split_by_label(rows, ids, label, test_size, seed)
    if out is not None:
        tables.write_by_label(parts, out, label, extra=("subset",))
    return parts


def split_report(df: DataFrame, parts: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per label and subset; labels too small to split are listed with zeros."""
    total = df.groupBy(col(label)).agg(F.count("*").alias("total"))
    sides = parts.groupBy(col(label)).agg(
        F.count_if(F.col("subset") == "train").alias("train"),
        F.count_if(F.col("subset") == "test").alias("test"),
    )
    return total.join(sides, label, "left").na.fill(0, ["train", "test"])


def encode_labels(
    df: DataFrame, enc: encode.Encoders, spec: DatasetSpec, kind: str,
    labels: Sequence[str] | None = None, exclude: Sequence[str] = (), subset: str = "train",
    out: str | None = None,
) -> DataFrame:
    """Encode majority (`kind="standard"`) or minority labels, written by label code."""
    known = spec.majority if kind == "standard" else spec.minority
    rows = clean.filter_labels(df, spec.label, known, labels, exclude)
    encoded = (
        encode.encode_majority(rows, enc, spec, subset) if kind == "standard"
        else encode.encode_minority(rows, enc, spec, kind)
    )
    if out is not None:
        encoded.write.mode("overwrite").partitionBy(spec.label).parquet(out)
    return encoded


def compress_majority(
    df: DataFrame, budget: int, ids: Sequence[str], spec: DatasetSpec, vector: str = "features",
    labels: Sequence[str] | None = None, exclude: Sequence[str] = (), **options,
) -> DataFrame:
    """Every chosen majority label reduced to the budget; original rows come back."""
    chosen = clean.resolve_labels(spec.majority, labels, exclude)
    return compress.compress_labels(
        df, {x: budget for x in chosen}, ids, spec.label, vector, **options
    )


def augment_label(
    train_rows: DataFrame, test_rows: DataFrame, label_value: str, tau: int,
    generate: augment.Generator, features: Sequence[str], order: Sequence[str | Column],
    spec: DatasetSpec, **options,
) -> DataFrame:
    """Fill one small label up to `tau` with admitted synthetic rows; originals included.

    A label that has enough rows passes unchanged.
    """
    rows = train_rows.where(col(spec.label) == label_value)
    need = tau - rows.count()
    if need <= 0:
        return dedup.dedup(rows)
    accepted = augment.augment_until(
        generate, [train_rows, test_rows], features, order, need,
        spec.accept_rate(label_value), **options,
    )
    return augment.merge_augmented(rows, accepted)


def merge(
    majority: Sequence[tuple[str, DataFrame]], minority: Sequence[tuple[str, str, DataFrame]],
    ids: Sequence[str], out: str | None = None,
) -> DataFrame:
    """Compressed majority and augmented minority parts as one shuffled train table."""
    merged = score.merge_train(majority, minority, ids)
    if out is not None:
        tables.write_table(merged, out, order="position")
    return merged


def evaluate(
    model: train.TrainedModel, df: DataFrame, classes: Sequence[int], vector: str = "features",
    y: str = "y",
) -> tuple[DataFrame, DataFrame]:
    """(metrics, confusion counts) of one model."""
    scored = model.score(df, vector).select(y, "pred")
    return score.classification_metrics(scored, y), score.confusion_matrix(scored, classes, y)


def ensemble(
    models: Sequence[train.TrainedModel], df: DataFrame, k: int, ids: Sequence[str],
    exclude: Sequence[str] = (), prefer: str = "histgbm", weights: dict[str, float] | None = None,
    vector: str = "features",
) -> DataFrame:
    """Weighted vote of several models over one table."""
    scored = [
        m.score(df, vector).select(*[col(i) for i in ids], F.lit(m.kind).alias("model"), "proba")
        for m in models
    ]
    probs = scored[0]
    for s in scored[1:]:
        probs = probs.unionByName(s)
    return score.combine_weighted(clean.exclude_models(probs, exclude, prefer), k, weights, ids)


@dataclass(frozen=True)
class MergedSources:
    rows: DataFrame
    before_after: DataFrame
    crosstab: DataFrame
    overlap: DataFrame


def merge_perturbed(
    sources: DataFrame, plain: DataFrame, features: Sequence[str], order: Sequence[str | Column],
    attacks: Sequence[str], labels: Sequence[str] | None = None, label: str = "Label",
    source: str = "__attack__",
) -> MergedSources:
    """Perturbed rows of all sources: distinct per source, merged over sources, new to train.

    `sources` is the union of the source tables with a source column.
    """
    inner = dedup.dedup_by_features(sources, [source, *features], order)
    merged = stage(dedup.merge_sources(inner, features, order, label, source))
    return MergedSources(
        rows=dedup.exclude_known(merged, plain, features),
        before_after=report.pre_post_counts(sources, features, source, label),
        crosstab=report.crosstab_exploded(merged, label, source, labels),
        overlap=report.source_overlap(merged, attacks, source),
    )


def balance_perturbed(
    merged: DataFrame, threshold: int, features: Sequence[str], ids: Sequence[str],
    label: str | None = None, source: str = "__attack__", keep_key: bool = False,
) -> DataFrame:
    """Up to `threshold` rows per source, balanced over labels, each feature tuple once."""
    label = clean.detect_label_column(merged.columns, label)
    keyed = clean.with_row_key(merged, features)
    out = sample.balance_sources(keyed, threshold, ids, label, source)
    return out if keep_key else clean.drop_tech_cols(out)


def distribution_report(
    df: DataFrame, wanted: Sequence[str] | None = None, label: str | None = None,
    source: str = "__attack__", labels: Sequence[str] | None = None,
) -> DataFrame:
    """Source x label counts, optionally for some sources only."""
    label = clean.detect_label_column(df.columns, label)
    groups = df.groupBy(col(source), col(label)).agg(F.count("*").alias("__w__"))
    rows = report.explode_sources(groups, source)
    if wanted is not None:
        rows = clean.filter_sources(rows, wanted, source)
    return report.crosstab(rows, source, label, labels, weight=F.col("__w__"))


def robustness_report(
    plain: DataFrame, pert: DataFrame, truth: DataFrame, k: int, models: Sequence[str],
    weights: dict[str, float] | None = None, ids: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """Per model and for the vote: accuracy, F1 and ASR under every attack all models have."""
    complete = tables.require_all_sources(pert.select("model", "attack").distinct(), models)
    # attack names are few; as a list they prune the scan of the perturbed samples
    pert = pert.where(F.col("attack").isin([r["attack"] for r in complete.collect()]))
    alone = dedup.align_by_id(
        dedup.align_by_id(truth, plain.select(*ids, "model", _pred("plain_pred")), ids),
        pert.select(*ids, "model", "attack", _pred("pert_pred")), [*ids, "model"],
    )
    each = score.robustness_table(alone)
    return each.unionByName(
        score.ensemble_asr(plain, pert, truth, k, weights, ids).select(*each.columns)
    )


def _pred(name: str) -> Column:
    return argmax_class(F.col("proba")).alias(name)


def squeezed_inputs(
    inputs: DataFrame, spec: DatasetSpec, depths: dict[str, int], clip: DataFrame,
    default_depth: int = 8,
) -> Callable[[str], DataFrame]:
    """Input of a model kind with its features reduced to the model's bit depth."""
    def of(kind: str) -> DataFrame:
        depth = depths.get(kind, default_depth)
        return encode.squeeze_features(inputs, spec.ordered_features, depth, clip)

    return of
