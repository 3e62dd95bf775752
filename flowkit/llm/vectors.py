"""Exact top-k by pivots, and near-duplicate embeddings by an inverted multi-index.

Both operators take vectors of unequal length as padded with zeros. A vector that is null or holds
a null or non-finite component takes no part. Every row is a vector of its own, also if its id is
repeated; a null id sorts last. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowkit.llm.common import components, local_roots
from flowkit.staging import stage

# ---- exact top-k -------------------------------------------------------------------------------

TOP = 20
SCALE = 64
PIVOTS = 64
PIVOT_SAMPLE = 2048
CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 1024
STEP = 256
LAST_ID = (1 << 63) - 1


def _valid(v: str) -> str:
    return (f"coalesce({v} is not null and not exists({v}, x -> x is null or isnan(x) "
            f"or abs(x) = double('infinity')), false)")


def _rows(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", F.expr("transform(embedding, x -> double(x))").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int, dtype) -> np.ndarray:
    out = np.zeros((len(column), dims), dtype)
    for k, v in enumerate(column):
        x = v.values.to_numpy(zero_copy_only=False)
        out[k, :len(x)] = x
    return out


def _sample(rows: DataFrame, key: str, n: int, at_most: int, dims: int) -> np.ndarray:
    """At most about `at_most` vectors, chosen by a hash: a bounded sample for fitting an index."""
    spread = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(spread < at_most / max(1, n)).select(key, "v").toArrow().sort_by(key)
    return _matrix(got.column("v"), dims, np.float64)


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of pivots."""
    if not len(sample):
        return sample
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def dot_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; sums outside 64 bits stop at the borders of the type."""
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0))
    if largest * max(1, len(query)) < 2.0**53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors]
    return np.array([max(-LAST_ID - 1, min(LAST_ID, x)) for x in exact], np.int64)


def telling_pivots(dims: int, pivots: int) -> int:
    """How many pivots bound a candidate: reading one costs several components of a product."""
    return min(pivots, max(1, dims // 8))


def best_of_block(query: np.ndarray, to_pivots: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray,
                  vectors: np.ndarray, table: np.ndarray, norms: np.ndarray, k: int, plain: np.ndarray | None = None):
    """Positions and scores of the k best candidates, ties to the smaller id.

    A pivot bounds the distance from below, hence the inner product from above. `table` holds one row
    per pivot: the distances of all candidates to it. The query's farthest and nearest pivots are read, as
    they tell most. The candidates of the highest bounds are evaluated first; then those whose bound
    reaches the k-th score. `plain` may hold the vectors as doubles, if all their products are exact there.
    """
    many = telling_pivots(len(query), len(table))
    by = np.argsort(to_pivots)
    low = np.zeros(len(rows))
    for p in np.concatenate([by[:(many + 1) // 2], by[len(by) - many // 2:]]):
        np.maximum(low, np.abs(table[p] - to_pivots[p]), out=low)
    square = float((query.astype(np.float64) ** 2).sum())
    bound = (norms + square - low * low) / 2
    bound += 1e-9 * (norms + square) + 1e-3
    bound[rows == own] = -np.inf

    def scores(at: np.ndarray) -> np.ndarray:
        if plain is None:
            return dot_products(vectors[at], query)
        x = query.astype(np.float64)
        return (plain @ x)[at].astype(np.int64) if 2 * len(at) > len(plain) else (plain[at] @ x).astype(np.int64)

    first = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
    first = first[rows[first] != own]
    score = scores(first)
    least = np.partition(score, -k)[-k] if len(score) >= k else -np.inf
    rest = bound >= least
    rest[first] = False
    rest = np.flatnonzero(rest & (rows != own))
    at, score = np.concatenate([first, rest]), np.concatenate([score, scores(rest)])
    if len(at) > k:  # with the ties of the k-th score
        good = score >= np.partition(score, -k)[-k]
        at, score = at[good], score[good]
    best = np.lexsort((ids[at], -score))[:k]
    return at[best], score[best]


def exact_top_k(embeddings: DataFrame, every: int = 20, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`.

    Components become floor(64 x). Query blocks meet candidate blocks of bounded size; each pair of
    blocks gives the k best per query, which are merged. Equal scores go to the smaller id.
    """
    ints = _rows(embeddings).where(_valid("v")).select(
        F.coalesce("vec_id", F.lit(LAST_ID)).alias("id"),
        F.expr(f"transform(v, x -> floor({SCALE} * x))").alias("v"))
    rows = stage(ints.withColumn("row", F.monotonically_increasing_id()))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    is_query = (F.col("id") % every == 0) & (F.col("id") != LAST_ID)
    n_query = rows.where(is_query).count()
    pivots = spread_pivots(_sample(rows, "row", n, PIVOT_SAMPLE, dims), PIVOTS)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            v = _matrix(batch.column(2), dims, np.int64)
            x = v.astype(np.float64)
            d = np.sqrt(np.maximum(((x[:, None, :] - p[None]) ** 2).sum(2), 0)) if len(p) else np.zeros((len(x), 0))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in v], pa.binary()),
                 pa.array([r.tobytes() for r in d], pa.binary())], ["row", "id", "v", "d"])

    table = stage(rows.select("row", "id", "v").mapInArrow(measure, "row long, id long, v binary, d binary"))
    c_blocks, q_blocks = max(1, ceil(n / CANDIDATE_BLOCK)), max(1, ceil(n_query / QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row", F.lit(own_n)), F.lit(own_n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    queries = dealt(table.where(is_query), "qb", q_blocks, "cb", c_blocks)
    # both sides read one table: new names keep the optimizer from taking their columns for the same
    candidates = dealt(table, "cb", c_blocks, "qb", q_blocks).toDF(
        "row_c", "id_c", "v_c", "d_c", "cb", "qb")
    out = "row long, query_id long, vec_id long, score long"

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        def read(t: pa.Table):
            v = np.frombuffer(b"".join(t.column(2).to_pylist()), np.int64).reshape(t.num_rows, dims)
            d = np.frombuffer(b"".join(t.column(3).to_pylist()), np.float64).reshape(t.num_rows, -1) if len(
                shared.value) else np.zeros((t.num_rows, 0))
            return t.column(0).to_numpy(), t.column(1).to_numpy(), v, d

        got = []
        if q.num_rows and c.num_rows:
            rows_, ids, v, d = read(c)
            plain = v.astype(np.float64)
            norms, d = (plain ** 2).sum(1), np.ascontiguousarray(d.T)
            asked = read(q)
            largest = float(np.abs(v).max(initial=0)) * float(np.abs(asked[2]).max(initial=0))
            plain = plain if largest * max(1, dims) < 2.0**53 else None
            for row, id_, x, to in zip(*asked):
                at, score = best_of_block(x, to, row, rows_, ids, v, d, norms, k, plain)
                got.append((np.full(len(at), row), np.full(len(at), id_), ids[at], score))
        cols = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), cols)))

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(search, out)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("vec_id") != LAST_ID, F.col("vec_id")).alias("vec_id"), "score")


# ---- near-duplicates ---------------------------------------------------------------------------

SIMILAR = 0.9
TARGET = 0.98
#: Vectors to fit on: at least the first number, and so many for each word.
CODEBOOK_SAMPLE = 4096
WORD_SAMPLE = 32
CALIBRATION_SAMPLE = 1024
CELL_ROWS = 200
MOST_WORDS = 1024
RESIDENTS = 2048
VISITORS = 4096


def k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from a farthest-first start."""
    c = spread_pivots(x, k).copy()
    for _ in range(rounds):
        norms = (c * c).sum(1)
        near = np.concatenate([(norms - 2 * x[a:a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)])
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
    return c


class MultiIndex:
    """A product grid of two codebooks, one per half of the vectors."""

    def __init__(self, sample: np.ndarray, unseen: np.ndarray, words: int, similar: float, target: float) -> None:
        """Codebooks from `sample`; the number of cells to visit from `unseen`, which has none of it."""
        self.half = sample.shape[1] // 2
        self.books = [k_means(s, words) for s in (sample[:, :self.half], sample[:, self.half:])]
        self.sizes = [len(b) for b in self.books]
        self.visits = self._calibrate(unseen, similar, target)

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = (x[:, :self.half], x[:, self.half:])
        return [(p * p).sum(1)[:, None] - 2 * p @ b.T + (b * b).sum(1) for p, b in zip(parts, self.books)]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self._distances(x)
        return a.argmin(1) * self.sizes[1] + b.argmin(1)

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first n cells in multi-sequence order: by the sum of both half distances.

        The cell of ranks (a, b) can be among the first n only if (a + 1)(b + 1) <= n.
        """
        a, b = self._distances(x)
        ra, rb = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        i, j = np.meshgrid(np.arange(self.sizes[0]), np.arange(self.sizes[1]), indexing="ij")
        ok = (i + 1) * (j + 1) <= n
        i, j = i[ok], j[ok]
        total = np.take_along_axis(a, ra, 1)[:, i] + np.take_along_axis(b, rb, 1)[:, j]
        first = np.argsort(total, 1, kind="stable")[:, :n]
        return ra[np.arange(len(x))[:, None], i[first]] * self.sizes[1] + rb[np.arange(len(x))[:, None], j[first]]

    def _rank_of(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Cells of a smaller or equal sum of distances, besides the given one of each row, by counting."""
        out = np.zeros(len(x), np.int64)
        for k, (a, b) in enumerate(zip(*self._distances(x))):
            goal = a[cells[k] // self.sizes[1]] + b[cells[k] % self.sizes[1]]
            out[k] = np.searchsorted(np.sort(b), goal + 1e-9 - a, "right").sum() - 1
        return out

    def _calibrate(self, unseen: np.ndarray, similar: float, target: float) -> int:
        """Cells to visit so that the share `target` of pairs exactly at the threshold meets: the
        home of one is among the cells of the other. Pairs are made from the vectors by rotation."""
        n_cells = self.sizes[0] * self.sizes[1]
        x = unseen
        if n_cells <= 2 or not len(x):
            return max(1, n_cells)
        side = np.random.default_rng(7).normal(size=x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        y = similar * x + sqrt(1 - similar * similar) * side
        rank = np.minimum(self._rank_of(x, self.home(y)), self._rank_of(y, self.home(x)))
        return min(n_cells, int(np.quantile(rank, target, method="higher")) + 1)


def near_duplicates(embeddings: DataFrame, similar: float = SIMILAR, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors are merged first. Each vector lives in its home cell and visits the nearest
    cells; visitors and residents of a cell meet in chunks of bounded size and are verified by
    cosine in double precision. A pair that meets twice counts once. Chunks return counts and a
    spanning forest, never pairs. Zero vectors link with nothing.
    """
    spark = embeddings.sparkSession
    norm = "aggregate(v, 0D, (t, x) -> t + x * x)"
    rows = _rows(embeddings).withColumn("ok", F.expr(f"{_valid('v')} and coalesce({norm} > 0, false)"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    classes = stage(rows.where("ok").groupBy("v").agg(
        F.count("*").alias("times"), F.min("vec_id").alias("first"), F.min("row").alias("c")))
    n, dims = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    members = rows.where("ok").join(classes.select("v", "c", "times", "first"), "v").select("row", "c", "times")
    if n:
        counts, edges = _meet(classes, n, max(2, dims), similar, target)
    else:
        counts = spark.createDataFrame([], "c long, links long")
        edges = spark.createDataFrame([], "u long, v long")
    roots = components(edges)
    rooted = stage(classes.select("c", "first").join(roots.withColumnRenamed("node", "c"), "c", "left").select(
        "c", "first", F.coalesce("root", "c").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component"))
    by_class = stage(rooted.join(ids, "root").join(counts, "c", "left").select(
        "c", "component", F.coalesce("links", F.lit(0)).alias("links")))
    known = stage(members.join(by_class, "c").select(
        "row", (F.col("links") + F.col("times") - 1).alias("n_links"), "component"))
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.select("row", "vec_id").join(known, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _meet(classes: DataFrame, n: int, dims: int, similar: float, target: float) -> tuple[DataFrame, DataFrame]:
    """Links per class, weighted by the copies of the other side, and forest edges."""
    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, initial=0.0, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    words = max(1, min(MOST_WORDS, round(sqrt(n / CELL_ROWS))))
    fit = max(CODEBOOK_SAMPLE, WORD_SAMPLE * words)
    sample = unit(_sample(classes, "c", n, fit + CALIBRATION_SAMPLE, dims))
    if not len(sample):
        sample = unit(_matrix(classes.limit(1).toArrow().column("v"), dims, np.float64))
    # few vectors are split in the same proportion; one alone is both
    every = -(-(fit + CALIBRATION_SAMPLE) // CALIBRATION_SAMPLE)
    apart = np.arange(len(sample)) % every == every - 1
    seen, unseen = (sample[~apart], sample[apart]) if apart.any() else (sample, sample)
    shared = classes.sparkSession.sparkContext.broadcast(MultiIndex(seen, unseen, words, similar, target))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = unit(_matrix(part.column(2), dims, np.float64))
                home, cells = index.home(x), index.nearest_cells(x, index.visits)
                own = [np.union1d(c, [h]).astype(np.int32) for c, h in zip(cells, home)]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array(home.astype(np.int32)), pa.array(own, pa.list_(pa.int32()))],
                    ["c", "times", "x", "home", "cells"])

    placed = stage(classes.select("c", "times", "v").mapInArrow(
        place, "c long, times long, x binary, home int, cells array<int>"))
    visits = placed.select("c", F.explode("cells").alias("cell"))
    sizes = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("nr")).join(
        visits.groupBy("cell").agg(F.count("*").alias("nv")), "cell").select(
        "cell", F.ceil(F.col("nr") / RESIDENTS).cast("int").alias("nr"),
        F.ceil(F.col("nv") / VISITORS).cast("int").alias("nv"))
    sizes = stage(sizes)

    def part(salt: int, of: str):
        return F.expr(f"cast(pmod(xxhash64(c, {salt}), {of}) as int)")

    residents = placed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("rp", part(1, "nr")).withColumn(
        "vp", F.explode(F.expr("sequence(0, nv - 1)"))).select("cell", "rp", "vp", "c", "times", "x", "cells").toDF(
        "cell", "rp", "vp", "c", "times", "x", "cells")
    visitors = placed.withColumn("cell", F.explode("cells")).join(sizes, "cell").withColumn(
        "vp", part(2, "nv")).withColumn("rp", F.explode(F.expr("sequence(0, nr - 1)"))).select(
        "cell", "rp", "vp", "c", "times", "x", "home").toDF("cell", "rp", "vp", "c", "times", "x", "home")

    def verify(r: pa.Table, v: pa.Table) -> pa.Table:
        names = ("c", "links", "root")
        if not r.num_rows or not v.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        x, y = (np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(-1, dims) for t in (r, v))
        rc, vc = r.column("c").to_numpy(), v.column("c").to_numpy()
        rt, vt = r.column("times").to_numpy(), v.column("times").to_numpy()
        cell, home = r.column("cell")[0].as_py(), v.column("home").to_numpy()
        lists = r.column("cells").combine_chunks()
        border, visited = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        links = np.zeros(len(rc) + len(vc), np.int64)
        near_i, near_j = [], []
        for a in range(0, len(vc), 512):
            j, i = np.nonzero(y[a:a + 512] @ x.T >= similar)
            j += a
            other = vc[j] != rc[i]
            i, j = i[other], j[other]
            same = home[j] == cell
            np.add.at(links, len(rc) + j[same], rt[i[same]])
            far = np.flatnonzero(home[j] > cell)
            met = np.array([home[j[f]] in visited[border[i[f]]:border[i[f] + 1]] for f in far], bool)
            count = ~same
            count[far[met]] = False
            np.add.at(links, len(rc) + j[count], rt[i[count]])
            np.add.at(links, i[count], vt[j[count]])
            near_i.append(i)
            near_j.append(j + len(rc))
        root = local_roots(len(links), np.concatenate(near_i), np.concatenate(near_j))
        c = np.concatenate([rc, vc])
        out = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
        return pa.table({"c": c[out], "links": links[out], "root": c[root[out]]})

    key = ["cell", "rp", "vp"]
    met = stage(residents.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInArrow(
        verify, "c long, links long, root long"))
    counts = met.groupBy("c").agg(F.sum("links").alias("links"))
    return counts, met.where("c <> root").select(F.col("c").alias("u"), F.col("root").alias("v"))
