"""Compression of large classes: clusters, representatives, edges, density filter, core-set."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkit.functions import boundary_score, col, euclidean
from flowkit.operators import kmeans
from flowkit.operators.cells import matrix
from flowkit.operators.dedup import select_back
from flowkit.operators.farthest import farthest_first, numbered
from flowkit.operators.nearest import nearest_distance
from flowkit.operators.ranking import exact_percentiles, hash_take, take_smallest
from flowkit.operators.sample import argmin_per_group
from flowkit.staging import bounded, lookup, scratch, stage

CENTRE_ROWS = 100_000
SLACK = 1e-12  # relative; rounding of the interpolated percentile must not lose the row it hits


# ---- clusters -------------------------------------------------------------------------------

def n_clusters(
    n: int, budget: int, strategy: str = "diverse", avg: float = 3.0, explicit: int | None = None
) -> int:
    """Explicit k, else about `budget` (core) or `budget / avg` (diverse); never more than rows."""
    if explicit is not None:
        k = explicit
    else:
        k = budget if strategy == "core" else math.ceil(budget / avg)
    if k <= 0:
        raise ValueError("the number of clusters must be positive")
    return min(k, n)


class Centres:
    """Cluster centres that place rows like a fitted k-means model; `inertia` lists the passes."""

    def __init__(self, centres: np.ndarray, inertia: Sequence[float] = ()) -> None:
        self.centres = np.asarray(centres, float)
        self.inertia = list(inertia)

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def fit_clusters(
    df: DataFrame, k: int, ids: Sequence[str], vector: str = "features", algo: str = "minibatch",
    batch: int | None = None, seed: int = 42, tol: float = 0.002, most_passes: int = 10,
) -> Centres | KMeansModel:
    """k-means over all rows. `minibatch` is `kmeans.fit`, `full` runs Spark's Lloyd.

    `minibatch` seeds from a hash sample, in two levels when there are many centres, and passes
    over all rows until the inertia falls by less than `tol`; batches are the stored blocks, so
    `batch` has no effect.
    """
    if algo == "full":
        rows = df.select(array_to_vector(col(vector).cast("array<double>")).alias("__v__")).persist()
        try:
            return KMeans(
                k=k, seed=seed, initMode="k-means||", featuresCol="__v__", predictionCol="cluster"
            ).fit(rows)
        finally:
            rows.unpersist()
    found = kmeans.fit(df, k, ids, vector, seed, tol, most_passes)
    return Centres(found.centres, found.inertia)


def assign_clusters(
    df: DataFrame, model: Centres | KMeansModel, vector: str = "features"
) -> DataFrame:
    """Add `cluster` and `dist`, the distance to the own centre."""
    centres = np.array(model.clusterCenters(), float)
    shared = df.sparkSession.sparkContext.broadcast(kmeans.Finder(centres) if len(centres) else None)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, square = shared.value(matrix(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(number.astype(np.int32)), pa.array(np.sqrt(square))],
                names=[*batch.schema.names[:-1], "cluster", "dist"])

    kept = df.drop("cluster", "dist")
    schema = T.StructType([
        *kept.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    return kept.withColumn("__v__", col(vector).cast("array<double>")).mapInArrow(place, schema)


def group_centers(
    df: DataFrame, dim: int, keys: Sequence[str] = ("cluster",), vector: str = "features"
) -> DataFrame:
    """Mean vector per given cluster: (keys, centre)."""
    means = df.groupBy(*[col(k) for k in keys]).agg(
        *[F.avg(col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dim)]
    )
    return means.select(
        *[col(k) for k in keys], F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("centre")
    )


def distance_to_center(
    df: DataFrame, centres: DataFrame, keys: Sequence[str] = ("cluster",),
    vector: str = "features", name: str = "dist",
) -> DataFrame:
    joined = lookup(df, centres, list(keys), max_rows=CENTRE_ROWS)
    return joined.withColumn(name, euclidean(col(vector), F.col("centre"))).select(
        *df.columns, name
    )


def core_reps(
    df: DataFrame, ids: Sequence[str], keys: Sequence[str] = ("cluster",), value: str = "dist"
) -> DataFrame:
    """The row closest to the centre of each cluster."""
    return argmin_per_group(df, keys, ids, value)


def _beyond(value: str) -> Column:
    edge = F.col("__edge__")
    return col(value) >= edge - F.abs(edge) * SLACK


def edge_candidates(
    df: DataFrame, pct: float = 95.0, keys: Sequence[str] = ("cluster",), value: str = "dist"
) -> DataFrame:
    """Rows at or beyond the distance percentile of their cluster."""
    cut = exact_percentiles(df, keys, value, {"__edge__": pct / 100.0}).drop("__n__")
    return lookup(df, cut, list(keys)).where(_beyond(value)).select(*df.columns)


def round_robin_quotas(counts: DataFrame, group: Sequence[str], cluster: str, need: Column) -> DataFrame:
    """Give `need` picks to the clusters in turns until they run dry: (group, cluster, quota).

    `counts` has `n` per cluster. With clusters sorted by size, the number of full rounds follows
    from a running sum; the last, partial round goes to the clusters in order.
    """
    by = [col(g) for g in group]
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # rounds 1..n_i use every cluster that is at least that large
    sized = whole.orderBy("n", cluster)
    before = sized.rowsBetween(Window.unboundedPreceding, -1)
    alive = F.count("*").over(whole) - F.row_number().over(sized) + 1
    smaller = F.coalesce(F.sum("n").over(before), F.lit(0))
    staged = (
        counts.withColumn("__need__", need.cast("bigint"))
        .withColumn("__alive__", alive).withColumn("__smaller__", smaller)
    )
    # largest full level with all clusters of rank >= i still alive, cut to this cluster's size
    level = F.floor((F.col("__need__") - F.col("__smaller__")) / F.col("__alive__"))
    staged = staged.withColumn("__level__", F.least(level, F.col("n")))
    staged = staged.withColumn("__full__", F.max("__level__").over(whole))
    staged = staged.withColumn("__base__", F.greatest(F.lit(0), F.least(F.col("n"), F.col("__full__"))))
    left = F.col("__need__") - F.sum("__base__").over(whole)
    more = (F.col("n") > F.col("__base__")).cast("int")
    turn = F.sum(more).over(whole.orderBy(cluster).rowsBetween(Window.unboundedPreceding, 0))
    extra = F.when((more == 1) & (turn <= left), 1).otherwise(0)
    return staged.select(
        *by, col(cluster), (F.col("__base__") + extra).cast("bigint").alias("quota")
    )


def distribute_edges(
    candidates: DataFrame, need: int | DataFrame, ids: Sequence[str], group: Sequence[str] = (),
    cluster: str = "cluster", value: str = "dist", seed: int = 42,
) -> DataFrame:
    """Spread edge picks over the clusters: farthest rows first, one per cluster and turn."""
    counts = candidates.groupBy(*[col(g) for g in group], col(cluster)).agg(
        F.count("*").alias("n")
    )
    if isinstance(need, DataFrame):
        counts = lookup(counts, need, list(group))
        quota = round_robin_quotas(counts, group, cluster, F.col("need"))
    else:
        quota = round_robin_quotas(counts, group, cluster, F.lit(need))
    far = candidates.withColumn("__far__", -col(value))
    return take_smallest(
        far, [*group, cluster], "__far__", ids, bounded(quota)[0], seed
    ).drop("__far__")


def compress(
    df: DataFrame, budget: int | dict[str, int], ids: Sequence[str],
    group: Sequence[str] = ("Label",), strategy: str = "diverse", pct: float = 95.0, fallback: str = "edge_topup",
    cluster: str = "cluster", value: str = "dist", seed: int = 42,
) -> DataFrame:
    """Pick about `budget` rows per group from rows with a cluster and a distance.

    core: the closest row of each cluster. When that leaves room, edge rows are spread over the
    clusters and the closest remaining rows fill up, or random rows do (`core` with
    `fallback="random"`). `diverse` trims an over-full core by dropping its closest rows first;
    `core` does not trim. Adds `role`: core, edge, topup or random. The budget may be a mapping
    by the value of the (single) group column.
    """
    if strategy not in ("core", "diverse"):
        raise ValueError(f"unknown strategy: {strategy}")
    keys, id_cols = list(group), list(ids)
    if isinstance(budget, dict):
        limit = F.coalesce(*[F.when(col(keys[0]) == x, F.lit(b)) for x, b in budget.items()], F.lit(0))
    else:
        limit = F.lit(budget)
    rows = stage(df.select(*[col(c) for c in (*keys, cluster, *id_cols, value)]))
    core = core_reps(rows, id_cols, [*keys, cluster], value)
    n_core = bounded(core.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n_core")))[0]
    room = n_core.select(*keys, F.greatest(F.lit(0), limit - F.col("n_core")).alias("need"))

    if strategy == "diverse" and not n_core.where(F.col("n_core") > limit).isEmpty():
        far = core.withColumn("__far__", -col(value))
        core = take_smallest(
            far, keys, "__far__", id_cols, n_core.select(*keys, limit.alias("quota")), seed
        ).drop("__far__")
    core = stage(core.select(*rows.columns).withColumn("role", F.lit("core")))
    rest = rows.join(core.select(*id_cols), id_cols, "left_anti")

    if strategy == "core" and fallback == "random":
        fill = hash_take(rest, keys, id_cols, seed, room.withColumnRenamed("need", "quota"))
        return core.unionByName(fill.withColumn("role", F.lit("random")))

    # edges may coincide with core rows; those picks do not use up room
    edges = distribute_edges(
        edge_candidates(rows, pct, [*keys, cluster], value), room, id_cols, keys, cluster, value,
        seed,
    )
    edges = stage(
        edges.select(*rows.columns).join(core.select(*id_cols), id_cols, "left_anti")
        .withColumn("role", F.lit("edge"))
    )
    n_edge = edges.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n_edge"))
    left = room.join(n_edge, keys, "left").select(
        *keys, (F.col("need") - F.coalesce(F.col("n_edge"), F.lit(0))).alias("quota")
    )
    rest = rest.join(edges.select(*id_cols), id_cols, "left_anti")
    topup = take_smallest(rest, keys, value, id_cols, bounded(left)[0], seed)
    return core.unionByName(edges).unionByName(topup.withColumn("role", F.lit("topup")))


def compress_labels(
    df: DataFrame, budgets: dict[str, int], ids: Sequence[str], label: str = "Label",
    vector: str = "features", strategy: str = "diverse", avg: float = 3.0, pct: float = 95.0,
    fallback: str = "edge_topup", algo: str = "minibatch", seed: int = 42,
) -> DataFrame:
    """Cluster each listed label, then select for all of them at once; original rows come back."""
    parts = []
    for name, budget in budgets.items():
        rows = df.where(col(label) == name)
        k = n_clusters(rows.count(), budget, strategy, avg)
        model = fit_clusters(rows, k, ids, vector, algo, seed=seed)
        parts.append(assign_clusters(rows, model, vector).select(
            *[col(c) for c in (label, "cluster", *ids, "dist")]
        ))
    placed = reduce(DataFrame.unionByName, parts)
    picked = compress(placed, budgets, ids, [label], strategy, pct, fallback, seed=seed)
    return select_back(df, picked, ids)


# ---- density filter, boundary, core-set -----------------------------------------------------

def density_filter(
    df: DataFrame, ids: Sequence[str], small_frac: float = 0.001, edge_pct: float = 92.0,
    large_keep: float = 0.03, min_keep: int = 50, cluster: str = "cluster", value: str = "dist",
    seed: int = 42,
) -> DataFrame:
    """All rows of small clusters; of large ones the edge and a random share of the rest.

    A cluster is small up to `ceil(small_frac * n)` rows. Adds `reason`: small, edge or sample.
    Passes over `df` several times, reading the ids, cluster and distance: stage it first when
    it is not a table.
    """
    sizes = bounded(df.groupBy(col(cluster)).agg(F.count("*").alias("__size__")))[0]
    total = sizes.agg(F.sum("__size__").alias("n"))
    limit = F.ceil(total.scalar() * F.lit(small_frac))
    sizes = bounded(sizes.withColumn("__small__", F.col("__size__") <= limit))[0]
    cut = exact_percentiles(df, [cluster], value, {"__edge__": edge_pct / 100.0}).drop("__n__")
    marked = lookup(lookup(df, sizes, [cluster]), cut, [cluster])
    marked = marked.withColumn(
        "reason",
        F.when(F.col("__small__"), "small").when(_beyond(value), "edge"),
    )
    rest = marked.where("reason is null")
    share = sizes.select(
        col(cluster),
        F.greatest(F.lit(min_keep), F.ceil(F.col("__size__") * F.lit(large_keep))).alias("quota"),
    )
    sampled = hash_take(rest, [cluster], ids, seed, share).withColumn("reason", F.lit("sample"))
    return marked.where("reason is not null").unionByName(sampled).select(*df.columns, "reason")


def with_boundary_score(
    left: DataFrame, right: DataFrame, ids: Sequence[str], vector: str = "features",
    broadcast_values: int | None = None,
) -> DataFrame:
    """Add `boundary_dist` and `boundary_score` towards the opposite class.

    The result is staged: what follows passes over it several times.
    """
    extra = {} if broadcast_values is None else {"broadcast_values": broadcast_values}
    near = nearest_distance(left, right, ids, vector, "boundary_dist", **extra)
    return stage(near.withColumn("boundary_score", boundary_score(F.col("boundary_dist"))))


def pin_boundary(
    df: DataFrame, budget: int, ids: Sequence[str], pin_frac: float = 0.3,
    score: str = "boundary_score", seed: int = 42,
) -> DataFrame:
    """The rows with the highest score: `pin_frac` of the budget."""
    low = df.withColumn("__low__", -col(score))
    return take_smallest(low, [], "__low__", ids, int(round(pin_frac * budget)), seed).drop("__low__")


def pin_report(pins: DataFrame, cluster: str = "cluster", score: str = "boundary_score") -> DataFrame:
    """Pins per cluster and the overall cut-off score."""
    cutoff = pins.agg(F.min(col(score)).alias("c"))
    return pins.groupBy(col(cluster)).agg(F.count("*").alias("pins")).withColumn(
        "cutoff", cutoff.scalar()
    )


def coreset(
    df: DataFrame, pins: DataFrame, budget: int, ids: Sequence[str], vector: str = "features",
    algo: str = "minibatch", seed: int = 42,
) -> DataFrame:
    """Pins plus one representative for each of `budget - pins` clusters of the other rows.

    With `algo="farthest"` the others are chosen farthest-first around the pins (see `farthest`):
    exactly `budget` rows, if there are so many.
    """
    pins, id_cols = stage(pins.select(*[col(i) for i in ids])), list(ids)
    if algo == "farthest":
        return _coreset_farthest(df, pins, budget, id_cols, vector, seed)
    rest = stage(df.join(pins, id_cols, "left_anti"))
    k = n_clusters(rest.count(), budget - pins.count(), "core")
    placed = assign_clusters(
        rest.withColumnRenamed("cluster", "__given__"),
        fit_clusters(rest, k, ids, vector, algo, seed=seed), vector,
    )
    reps = core_reps(placed, id_cols)
    picked = pins.withColumn("pinned", F.lit(True)).unionByName(
        reps.select(*id_cols).withColumn("pinned", F.lit(False))
    )
    return df.join(picked, id_cols)


def _coreset_farthest(
    df: DataFrame, pins: DataFrame, budget: int, ids: list[str], vector: str, seed: int
) -> DataFrame:
    rows = stage(numbered(df, col(vector)))
    first = matrix(rows.join(pins, ids, "left_semi").select("__v__").toArrow().column(0))
    rest = stage(rows.join(pins, ids, "left_anti"))
    need = budget - pins.count()
    numbers, _ = farthest_first(rest.select(F.col("__k__").alias("k"), F.col("__v__").alias("v")), first, need)
    picked = df.sparkSession.createDataFrame(
        pa.table({"__k__": pa.array(numbers, pa.int64())}), "__k__ long")
    others = lookup(rest, picked, ["__k__"])
    if len(numbers) < need:  # the remaining rows repeat chosen vectors
        more = rest.join(picked, "__k__", "left_anti")
        others = others.unionByName(hash_take(more, [], ids, seed, need - len(numbers)))
    return rows.join(pins, ids, "left_semi").withColumn("pinned", F.lit(True)).unionByName(
        others.withColumn("pinned", F.lit(False))).drop("__k__", "__v__")


def coreset_quality(
    full: DataFrame, core: DataFrame, ids: Sequence[str], vector: str = "features",
    cluster: str = "cluster", score: str = "boundary_score",
) -> DataFrame:
    """One row: covering radius, cluster coverage, scores and pins of a core-set.

    The smallest tenth of the clusters counts as small.
    """
    radius = stage(nearest_distance(
        full.select(*[col(i) for i in ids], col(vector)), core, ids, vector, "radius"
    ).select("radius"))
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    reach = exact_percentiles(radius, [], "radius", {f"radius_{k}": p for k, p in shares.items()})
    scores = exact_percentiles(core, [], score, {f"score_{k}": p for k, p in shares.items()})
    kept = core.groupBy(col(cluster)).agg(F.count("*").alias("kept"))
    sizes = full.groupBy(col(cluster)).agg(F.count("*").alias("n"))
    by_size = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(by_size.orderBy("n", cluster))
    small = rank <= F.ceil(F.count("*").over(by_size) * F.lit(0.1))
    coverage = (
        sizes.withColumn("small", small).join(kept, cluster, "left")
        .agg(
            F.count("*").alias("clusters"), F.count("kept").alias("clusters_kept"),
            F.count_if("small").alias("small_clusters"),
            F.count_if(F.col("small") & F.col("kept").isNotNull()).alias("small_kept"),
        )
    )
    chosen = core.agg(
        F.count("*").alias("rows"), F.avg(col(score)).alias("score_mean"),
        F.count_if("pinned").alias("pins"),
    )
    return chosen.select(
        "rows", "score_mean", "pins",
        *[coverage.select(c).scalar().alias(c) for c in coverage.columns],
        *[reach.select(f"radius_{k}").scalar().alias(f"radius_{k}") for k in shares],
        *[scores.select(f"score_{k}").scalar().alias(f"score_{k}") for k in shares],
    )


def pca(df: DataFrame, k: int, vector: str = "features", name: str = "pca") -> DataFrame:
    rows = df.withColumn("__v__", array_to_vector(col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="__v__", outputCol="__p__").fit(rows)
    return model.transform(rows).withColumn(name, vector_to_array("__p__")).drop("__v__", "__p__")
