"""Encoders as parameter tables: fit with one aggregate, apply as expressions, invert.

Parameter tables have one row per column, category or label. They are read to the driver when an
encoder is applied to columns; their size follows the schema, not the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.functions import col, half_even, inverse_normal, order_hash, sanitize_port
from flowkit.operators.clean import reorder, select_features
from flowkit.operators.dedup import dedup, dedup_ignoring
from flowkit.operators.report import continuous_stats, global_clip
from flowkit.operators.sample import stratified_split
from flowkit.spec import DatasetSpec
from flowkit.staging import bounded, lookup, stage

QUANTILES = 1000
VALUE_BUCKETS = 256
NORMAL_EDGE = 1e-7
PORTS = 65_535
TINY = 1e-9
DECIMALS = 8


# ---- fitting --------------------------------------------------------------------------------

def fit_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, std) from one aggregate; population deviation."""
    kinds = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    wide = df.agg(*[
        f(col(c).cast("double")).alias(f"{c}__{k}") for c in cols for k, f in kinds.items()
    ])
    rows = [
        F.struct(F.lit(c).alias("column"), *[col(f"{c}__{k}").alias(k) for k in kinds])
        for c in cols
    ]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def fit_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): sorted distinct values, codes from 0."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols
    ]))
    values = df.select(pairs.alias("x")).select("x.*").where("value is not null").distinct()
    order = Window.partitionBy("column").orderBy("value")
    return values.withColumn("code", (F.row_number().over(order) - 1).cast("int"))


def fit_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    """(label, code): sorted distinct labels, codes from 0."""
    values = df.select(col(label).alias("label")).where("label is not null").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("label")
    return values.withColumn("code", (F.row_number().over(order) - 1).cast("int"))


def fit_quantiles(
    df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), n_quantiles: int = QUANTILES
) -> DataFrame:
    """(column, quantiles): exact interpolated quantiles of all rows, for all columns at once.

    Counts per distinct value are ranked by a prefix sum over buckets of values and then within
    each bucket, so no column is one group. A column without values has no row. `ids` is not
    needed any more and stays for callers.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("v")) for c in cols
    ]))
    values = df.select(cells.alias("x")).select("x.*").where("v is not null and not isnan(v)")
    counts = stage(values.groupBy("column", "v").agg(F.count("*").alias("n")))
    cuts = [k / VALUE_BUCKETS for k in range(1, VALUE_BUCKETS)]
    bounds = counts.groupBy("column").agg(
        F.percentile_approx("v", cuts, 10 * VALUE_BUCKETS).alias("bounds"), F.sum("n").alias("total"))
    placed = lookup(counts, bounds, ["column"]).withColumn(
        "bucket", F.size(F.filter("bounds", lambda b: b < F.col("v"))))
    upto = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("column", "bucket").agg(F.sum("n").alias("inside"))
    base = sums.select("column", "bucket", (F.sum("inside").over(upto) - F.col("inside")).alias("base"))
    within = Window.partitionBy("column", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("inside", F.sum("n").over(within)).join(base, ["column", "bucket"]).select(
        "column", "v", "total", (F.col("base") + F.col("inside")).alias("upto"),
        (F.col("base") + F.col("inside") - F.col("n")).alias("from"))
    # grid points whose lower or upper neighbour has this value
    grid = F.array(*[F.lit(float(x)) for x in np.linspace(0.0, 1.0, n_quantiles)])
    steps, span = n_quantiles - 1, F.greatest(F.col("total") - 1, F.lit(1))
    first = F.greatest(F.lit(0), F.floor((F.col("from") - 1) * steps / span) - 1).cast("int")
    last = F.least(F.lit(steps), F.ceil(F.col("upto") * steps / span) + 1).cast("int")
    points = ranked.withColumn("i", F.explode(F.sequence(F.least(first, last), last))).withColumn(
        "at", F.get(grid, F.col("i")) * (F.col("total") - 1))
    held = lambda rank: F.when((rank >= F.col("from")) & (rank < F.col("upto")), F.col("v"))
    found = points.groupBy("column", "i").agg(
        F.max(held(F.floor("at"))).alias("low"), F.max(held(F.ceil("at"))).alias("high"), F.first("at").alias("at"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    return found.where("low is not null").groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("i", value.alias("q")))).alias("s")).select(
        "column", F.transform("s", lambda x: x["q"]).alias("quantiles"))


@dataclass(frozen=True)
class Encoders:
    """Fitted parameter tables of one dataset."""

    numeric: DataFrame
    labels: DataFrame
    categories: DataFrame | None = None
    quantiles: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        named = {
            "numeric": self.numeric, "labels": self.labels, "categories": self.categories,
            "quantiles": self.quantiles,
        }
        return {k: v for k, v in named.items() if v is not None}


def fit_encoders(
    train: DataFrame, spec: DatasetSpec, ids: Sequence[str] | None = None,
    n_quantiles: int = QUANTILES,
) -> Encoders:
    """Fit everything on train rows only, so nothing leaks from the test part.

    Each table is evaluated here, once, however often the encoders are applied.
    """
    def once(table: DataFrame) -> DataFrame:
        return bounded(table)[0]

    text = [c for c in spec.cat if c != spec.port]
    quantiles = None
    if spec.has_quantile and ids is not None:
        quantiles = once(fit_quantiles(train, spec.numeric, ids, n_quantiles))
    return Encoders(
        numeric=once(fit_numeric(train, spec.numeric)),
        labels=once(fit_labels(train, spec.label)),
        categories=once(fit_categories(train, text)) if text else None,
        quantiles=quantiles,
    )


def _by_column(params: DataFrame) -> dict[str, dict]:
    return {r["column"]: r.asDict() for r in params.collect()}


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])


# ---- numeric scalers ------------------------------------------------------------------------

def minmax(df: DataFrame, params: DataFrame, inverse: bool = False) -> DataFrame:
    """`(x - min) / (max - min)`; a constant column has range 1, one without values starts at 0."""
    exprs = {}
    for c, p in _by_column(params).items():
        if c not in df.columns:
            continue
        low, high = (0.0, 0.0) if p["min"] is None else (p["min"], p["max"])
        span = (high - low) or 1.0
        x = col(c).cast("double")
        exprs[c] = x * F.lit(span) + F.lit(low) if inverse else (x - F.lit(low)) / F.lit(span)
    return _replace(df, exprs)


def standardize(
    df: DataFrame, params: DataFrame, keep_raw: Sequence[str] = (), inverse: bool = False
) -> DataFrame:
    """`(x - mean) / std`; zero deviation counts as 1; `keep_raw` columns stay as they are."""
    exprs = {}
    for c, p in _by_column(params).items():
        if c not in df.columns or c in keep_raw:
            continue
        mean, std, x = p["mean"] or 0.0, p["std"] or 1.0, col(c).cast("double")
        exprs[c] = x * F.lit(std) + F.lit(mean) if inverse else (x - F.lit(mean)) / F.lit(std)
    return _replace(df, exprs)


def _to_uniform(quantiles: np.ndarray):
    """Empirical distribution function with the middle of the step at repeated quantiles."""
    refs = np.linspace(0.0, 1.0, len(quantiles))

    @F.pandas_udf("double")
    def transform(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        up = np.interp(v, quantiles, refs)
        down = -np.interp(-v, -quantiles[::-1], -refs[::-1])
        y = 0.5 * (up + down)
        y[v >= quantiles[-1]] = 1.0
        y[v <= quantiles[0]] = 0.0
        y[np.isnan(v)] = np.nan
        return pd.Series(y)

    return transform


def _from_uniform(quantiles: np.ndarray, normal: bool):
    refs = np.linspace(0.0, 1.0, len(quantiles))

    @F.pandas_udf("double")
    def transform(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        if normal:
            erf = np.frompyfunc(math.erf, 1, 1)
            v = 0.5 * (1.0 + erf(v / math.sqrt(2.0)).astype(float))
            # the forward map stops at the edge, so the edge means the end of the range
            v[v <= NORMAL_EDGE * (1.0 + 1e-6)] = 0.0
            v[v >= 1.0 - NORMAL_EDGE * (1.0 + 1e-6)] = 1.0
        return pd.Series(np.interp(v, refs, quantiles))

    return transform


def quantile_uniform(df: DataFrame, params: DataFrame, inverse: bool = False) -> DataFrame:
    """Map through the fitted empirical distribution to [0, 1], or back."""
    exprs = {}
    for c, p in _by_column(params).items():
        if c in df.columns:
            q = np.array(p["quantiles"], dtype=float)
            f = _from_uniform(q, normal=False) if inverse else _to_uniform(q)
            exprs[c] = f(col(c).cast("double"))
    return _replace(df, exprs)


def quantile_normal(df: DataFrame, params: DataFrame, inverse: bool = False) -> DataFrame:
    """Like `quantile_uniform`, followed by the normal quantile function."""
    if not inverse:
        uniform = quantile_uniform(df, params)
        exprs = {
            c: inverse_normal(
                F.greatest(F.lit(NORMAL_EDGE), F.least(F.lit(1.0 - NORMAL_EDGE), col(c)))
            )
            for c in _by_column(params) if c in df.columns
        }
        return _replace(uniform, exprs)
    exprs = {}
    for c, p in _by_column(params).items():
        if c in df.columns:
            exprs[c] = _from_uniform(np.array(p["quantiles"], dtype=float), normal=True)(
                col(c).cast("double")
            )
    return _replace(df, exprs)


# ---- categories, labels, binaries -----------------------------------------------------------

def _values_of(categories: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in categories.orderBy("column", "code").collect():
        out.setdefault(r["column"], []).append(r["value"])
    return out


def onehot(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Columns `<column>_<value>` in front, sources dropped; unknown values give all zeros."""
    values = _values_of(categories)
    hot = [
        F.when(col(c).cast("string") == v, 1.0).otherwise(0.0).alias(f"{c}_{v}")
        for c, vs in values.items() for v in vs
    ]
    return df.select(*hot, *[col(c) for c in df.columns if c not in values])


def onehot_inverse(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Value of the largest indicator; all zeros give null."""
    values = _values_of(categories)
    names = {f"{c}_{v}" for c, vs in values.items() for v in vs}
    back = []
    for c, vs in values.items():
        marks = [col(f"{c}_{v}") for v in vs]
        top = marks[0] if len(marks) == 1 else F.greatest(*marks)
        hits = [F.when((m == top) & (top > 0), F.lit(v)) for m, v in zip(marks, vs)]
        back.append(F.coalesce(*hits).alias(c))
    return df.select(*[col(c) for c in df.columns if c not in names], *back)


def ordinal(
    df: DataFrame, categories: DataFrame, cols: Sequence[str], unknown: int | None = None,
    inverse: bool = False,
) -> DataFrame:
    """Category to code by a joined lookup; unknown values give `unknown`, or an error if None."""
    source, target = ("code", "value") if inverse else ("value", "code")
    out = df
    for c in cols:
        table = categories.where(F.col("column") == c).select(
            F.col(source).cast("string").alias("__v__"), F.col(target).alias("__t__")
        )
        joined = lookup(out.withColumn("__v__", col(c).cast("string")), table, ["__v__"], "left")
        if inverse:
            value = F.col("__t__")
        elif unknown is None:
            failed = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.col("__v__")))
            value = F.when(F.col("__t__").isNull() & F.col("__v__").isNotNull(), failed.cast("int")).otherwise(F.col("__t__"))
        else:
            value = F.coalesce(F.col("__t__"), F.lit(unknown))
        out = joined.withColumn(c, value).select(*df.columns)
    return out


def ordinal_port(df: DataFrame, port: str, inverse: bool = False) -> DataFrame:
    """Fixed categories 1..65535: the code is the port less one, anything else gives -1."""
    p = col(port).cast("int")
    if inverse:
        return df.withColumn(port, p + 1)
    return df.withColumn(port, F.when(p.between(1, PORTS), p - 1).otherwise(-1))


def sanitize_ports(df: DataFrame, port: str) -> DataFrame:
    return df.withColumn(port, sanitize_port(col(port)))


def binary(df: DataFrame, cols: Sequence[str], inverse: bool = False) -> DataFrame:
    """To int; the inverse thresholds at 0.5."""
    return _replace(df, {
        c: (col(c) > 0.5).cast("int") if inverse else col(c).cast("int")
        for c in cols if c in df.columns
    })


def label_encode(
    df: DataFrame, labels: DataFrame, label: str = "Label", inverse: bool = False
) -> DataFrame:
    """Label to its code, or back; an unknown label is an error."""
    source, target = ("code", "label") if inverse else ("label", "code")
    table = labels.select(F.col(source).alias("__s__"), F.col(target).alias("__t__"))
    joined = lookup(df.withColumn("__s__", col(label)), table, ["__s__"], "left")
    failed = F.raise_error(F.concat(F.lit("unknown label: "), F.col("__s__").cast("string")))
    kind = "string" if inverse else "int"
    value = F.when(F.col("__t__").isNull(), failed.cast(kind)).otherwise(F.col("__t__"))
    return joined.withColumn(label, value).select(*df.columns)


# ---- decoding -------------------------------------------------------------------------------

def clean_decoded(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Tiny and negative values to 0, the rest rounded to 8 decimals."""
    return _replace(df, {
        c: F.when((F.abs(col(c)) < TINY) | (col(c) < 0), F.lit(0.0)).otherwise(
            half_even(col(c).cast("double"), DECIMALS)
        )
        for c in cols if c in df.columns
    })


def inverse_transform(
    df: DataFrame, enc: Encoders, spec: DatasetSpec, numeric: str = "quantile_normal"
) -> DataFrame:
    """The whole way back: one-hot, numeric, port, label, binary, clean-up, column order."""
    out = df
    if spec.onehot and enc.categories is not None:
        out = onehot_inverse(out, enc.categories)
    if numeric == "minmax":
        out = minmax(out, enc.numeric, inverse=True)
    elif numeric == "standard":
        out = standardize(out, enc.numeric, inverse=True)
    elif numeric in ("quantile_uniform", "quantile_normal"):
        if enc.quantiles is None:
            raise ValueError(f"{spec.name} has no quantile encoder")
        back = quantile_uniform if numeric == "quantile_uniform" else quantile_normal
        out = back(out, enc.quantiles, inverse=True)
    else:
        raise ValueError(f"unknown numeric inverse: {numeric}")
    if spec.port and spec.port in out.columns:
        out = sanitize_ports(out, spec.port)
    if spec.label in out.columns:
        out = label_encode(out, enc.labels, spec.label, inverse=True)
    out = binary(out, spec.binary, inverse=True)
    return reorder(clean_decoded(out, spec.cont), spec)


# ---- composed encodings ---------------------------------------------------------------------

def _finish(df: DataFrame, enc: Encoders, spec: DatasetSpec) -> DataFrame:
    out = label_encode(binary(df, spec.binary), enc.labels, spec.label)
    return onehot(out, enc.categories) if spec.onehot and enc.categories is not None else out


def encode_majority(
    df: DataFrame, enc: Encoders, spec: DatasetSpec, subset: str = "train", rowid: str = "__rowid__"
) -> DataFrame:
    """Standard scale, binary, label, one-hot, subset tag; equal encoded rows kept once."""
    out = _finish(standardize(df, enc.numeric), enc, spec).withColumn("__subset__", F.lit(subset))
    return dedup_ignoring(out, (rowid, "__subset__"), rowid)


def encode_minority(
    df: DataFrame, enc: Encoders, spec: DatasetSpec, kind: str = "minmax"
) -> DataFrame:
    """Min-max or quantile scale, then binary, label, one-hot."""
    if kind == "minmax":
        scaled = minmax(df, enc.numeric)
    elif kind == "quantile_uniform":
        if enc.quantiles is None:
            raise ValueError(f"{spec.name} has no quantile encoder")
        scaled = quantile_uniform(df, enc.quantiles)
    else:
        raise ValueError(f"unknown numeric encoder: {kind}")
    return _finish(scaled, enc, spec)


def _model_input(df: DataFrame, enc: Encoders, spec: DatasetSpec) -> DataFrame:
    out = df
    if spec.port and spec.port in out.columns:
        out = ordinal_port(sanitize_ports(out, spec.port), spec.port)
    text = [c for c in spec.cat if c != spec.port]
    if text and enc.categories is not None:
        out = ordinal(out, enc.categories, text)
    return binary(out, spec.binary)


@dataclass(frozen=True)
class Prepared:
    """Model input with its statistics; all lazy."""

    rows: DataFrame
    clip: DataFrame
    stats: DataFrame | None = None


def prepare_training(
    df: DataFrame, enc: Encoders, spec: DatasetSpec, val_size: float = 0.1, seed: int = 42,
    use_validation: bool = True, ids: Sequence[str] | None = None,
) -> Prepared:
    """Select, de-duplicate, encode without scaling, and split off a validation part.

    `stats` covers all rows, `clip` the train part, as the models expect. The distinct rows are
    staged, since several results use them. Without `ids` a hash of the row identifies it.
    """
    rows = stage(dedup(select_features(df, spec)))
    out = _model_input(rows, enc, spec)
    stats = continuous_stats(out.select(*[col(c).cast("float").alias(c) for c in spec.cont]), spec.cont)
    out = label_encode(out, enc.labels, spec.label)
    if use_validation:
        keyed = out if ids else out.withColumn("_key_", order_hash("row", out.columns))
        parts = stratified_split(keyed, ids or ["_key_"], spec.label, val_size, seed)
        out = parts.select(*[col(c) for c in out.columns], "subset")
    else:
        out = out.withColumn("subset", F.lit("train"))
    clip = global_clip(out.where("subset = 'train'"), spec.ordered_features)
    return Prepared(out, clip, stats)


def prepare_input(
    df: DataFrame, enc: Encoders, spec: DatasetSpec, include_label: bool = True
) -> Prepared:
    """Encode test or perturbed rows without scaling; `clip` covers these rows."""
    out = _model_input(select_features(df, spec) if include_label else df, enc, spec)
    if include_label:
        out = label_encode(out, enc.labels, spec.label)
    return Prepared(out, global_clip(out, spec.ordered_features))


def squeeze_features(
    df: DataFrame, cols: Sequence[str], bit_depth: int, clip: DataFrame
) -> DataFrame:
    """Reduce each feature to `2**bit_depth` levels within the clip range."""
    row = clip.select("clip_min", "clip_max").first()
    lo, hi = float(row["clip_min"]), float(row["clip_max"])
    span, levels = (hi - lo) or 1.0, float(2**bit_depth - 1)

    def squeezed(c: str) -> Column:
        x = F.greatest(F.lit(lo), F.least(F.lit(hi), col(c).cast("double")))
        return F.rint((x - lo) / span * levels) / levels * span + lo

    return _replace(df, {c: squeezed(c) for c in cols})


def input_norm(df: DataFrame, stats: DataFrame, eps: float = 1e-6) -> DataFrame:
    """`(x - mean) / std` at scoring time; deviations below `eps` count as 1."""
    exprs = {}
    for c, p in _by_column(stats).items():
        std = p["std"] if p["std"] >= eps else 1.0
        exprs[c] = (col(c).cast("double") - F.lit(p["mean"])) / F.lit(std)
    return _replace(df, exprs)
