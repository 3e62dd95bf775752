"""k-means over all rows of a table, for few or very many centres.

The rows are written once as blocks (binary matrices of single precision; sums are double). Seeds come from a bounded hash sample:
directly, or for many centres in two levels, coarse cells first and then the seeds of each cell in
its own task. Every pass maps the blocks to sums per centre and shuffles only those sums. The first
passes use a growing hash share of the rows, the others all rows, until the inertia stands still.
The centres are the one thing the driver and every task hold whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.functions import col
from flowkit.operators.cells import CellIndex, matrix, nearest_centre, runs
from flowkit.operators.sums import add_payloads
from flowkit.staging import scratch, stage

BLOCK_VALUES = 1 << 17  # numbers per stored block
DIRECT_SEEDS = 256  # up to so many centres are seeded from one sample
SAMPLE_ROWS = 20_000  # rows of that sample, and of the one the coarse cells come from
ROWS_PER_SEED = 24  # sampled rows per seed inside a coarse cell
LOCAL_PASSES = 5  # over the sample of a coarse cell
TRIES, TRY_PASSES = 6, 30  # of seeding from one sample: the best try counts, each until it rests
FIRST_SHARE = 1 / 16  # of the rows in the first pass; the share doubles until it is all of them
PART = 256  # centres whose sums travel together
INDEXED = 4096  # from so many centres on, rows find theirs through cells of centres


@dataclass
class Fit:
    """Fitted centres, and the sum of squared distances before each pass."""

    centres: np.ndarray
    inertia: list[float] = field(default_factory=list)


class Finder:
    """Nearest centre of rows: a plain search, or one over cells of centres when they are many."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        self.index = CellIndex(centres) if len(centres) >= INDEXED else None

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance)."""
        if self.index is None:
            number, distance = nearest_centre(x, self.centres)
        else:
            distance, number = self.index.nearest_with_number(x)
        return number, distance * distance


def best_seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The best of several tries of `spread_seeds`."""
    tries = [spread_seeds(x, k, rng, TRY_PASSES) for _ in range(TRIES)]
    return min(tries, key=lambda c: (nearest_centre(x, c)[1] ** 2).sum())


def spread_seeds(x: np.ndarray, k: int, rng: np.random.Generator, passes: int = LOCAL_PASSES) -> np.ndarray:
    """k-means++ seeds, then passes over `x`; repeated rows fill up where too few differ."""
    seeds = [x[rng.integers(len(x))]]
    open_ = ((x - seeds[0]) ** 2).sum(1)
    while len(seeds) < k:
        total = open_.sum()
        at = int(np.searchsorted(np.cumsum(open_), rng.random() * total)) if total > 0.0 else int(rng.integers(len(x)))
        seeds.append(x[min(at, len(x) - 1)])
        np.minimum(open_, ((x - seeds[-1]) ** 2).sum(1), out=open_)
    centres = np.array(seeds)
    last = np.inf
    for _ in range(passes):
        number, distance = nearest_centre(x, centres)
        now = (distance * distance).sum()
        if last - now <= 1e-4 * now:
            break
        last = now
        n, sums = _sums(x, number, k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _sums(x: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their sums per centre."""
    n = np.bincount(number, minlength=k)
    sums = np.zeros((k, x.shape[1]))
    order = np.argsort(number, kind="stable")
    starts = np.cumsum(n) - n
    some = n > 0
    if len(x):
        sums[some] = np.add.reduceat(x[order], starts[some], axis=0, dtype=float)
    return n, sums


def share_seeds(size: np.ndarray, spread: np.ndarray, k: int) -> np.ndarray:
    """Deal k seeds to cells by their inertia: at least one each, at most `size`, none above 8 k / cells
    while others have room."""
    weight = np.maximum(spread, 1e-300) ** 0.75
    out = np.minimum(1, size)
    cap = np.minimum(size, max(1, -(-8 * k // len(size))))
    while out.sum() < k:
        room = np.maximum(cap - out, 0)
        if not room.any():
            if (cap == size).all():
                break
            cap = size
            continue
        left = k - out.sum()
        part = weight * (room > 0)
        more = np.minimum(np.floor(left * part / part.sum()).astype(np.int64), room)
        if not more.any():
            more[np.argsort(-(part * (room > 0)), kind="stable")[: min(left, int((room > 0).sum()))]] = 1
        out = out + more
    return out


def fit(df: DataFrame, k: int, ids: Sequence[str], vector: str, seed: int = 42, tol: float = 0.002,
        most_passes: int = 10) -> Fit:
    """k centres from passes over growing shares and then all rows, until a pass lowers the inertia by less than `tol` of it."""
    share = F.pmod(F.xxhash64(*[col(i) for i in ids], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = df.select(col(vector).cast("array<double>").alias("v"), share.alias("h")).where("v is not null")
    with scratch(df.sparkSession):
        return _fit(rows, k, seed, tol, most_passes)


def _fit(rows: DataFrame, k: int, seed: int, tol: float, most_passes: int) -> Fit:
    rng = np.random.default_rng(seed)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # few input files must not keep the passes to few tasks
        rows = rows.repartition(cores)
    blocks = stage(rows.mapInArrow(_blocks, "dim int, n long, m binary, h binary"))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    if not n:
        return Fit(np.zeros((0, 0)))
    wanted = max(SAMPLE_ROWS, ROWS_PER_SEED * min(k, DIRECT_SEEDS))
    sample = _sample(blocks, wanted / n, seed)
    if k <= DIRECT_SEEDS or len(sample) == n:
        result = Fit(best_seeds(sample, k, rng))
    else:
        coarse = spread_seeds(sample, int(np.ceil(np.sqrt(k))), rng)
        result = Fit(_seeds_in_cells(blocks, coarse, k, n, seed))
    share = min(1.0, max(FIRST_SHARE, ROWS_PER_SEED * k / n))
    while share < 1.0:
        result.centres, _ = _pass(blocks, result.centres, share)
        share = min(1.0, 2.0 * share)
    for _ in range(most_passes):
        result.centres, inertia = _pass(blocks, result.centres)
        result.inertia.append(inertia)
        if len(result.inertia) > 1 and result.inertia[-2] - inertia <= tol * result.inertia[-2]:
            break
    return result


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, h) as blocks (dim, n, m, h)."""
    for batch in batches:
        v, h = matrix(batch.column("v")).astype(np.float32), batch.column("h").to_numpy()
        step = max(1, BLOCK_VALUES // max(1, v.shape[1]))
        out = [(i, min(i + step, len(v))) for i in range(0, len(v), step)]
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([v.shape[1]] * len(out), pa.int32()), "n": pa.array([b - a for a, b in out], pa.int64()),
            "m": pa.array([v[a:b].tobytes() for a, b in out], pa.binary()),
            "h": pa.array([h[a:b].tobytes() for a, b in out], pa.binary())})


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of every block."""
    for batch in batches:
        for dim, m, h in zip(*(batch.column(c) for c in ("dim", "m", "h"))):
            yield np.frombuffer(m.as_buffer(), np.float32).reshape(-1, dim.as_py()), np.frombuffer(h.as_buffer())


def _sample(blocks: DataFrame, share: float, seed: int) -> np.ndarray:
    """Rows whose hash is below the share: about `share` of all, whatever the partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, h in _each(batches):
            at = h <= share
            if at.any():
                order = np.argsort(h[at], kind="stable")
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array([h[at][order].tobytes()], pa.binary()), "m": pa.array([x[at][order].tobytes()], pa.binary())})

    got = blocks.mapInArrow(run, "h binary, m binary").toArrow()
    h = np.frombuffer(b"".join(got.column("h").to_pylist()))
    if not len(h):  # so small a share that no row fell into it
        return _sample(blocks, min(1.0, 16.0 * share), seed)
    x = np.frombuffer(b"".join(got.column("m").to_pylist()), np.float32).reshape(len(h), -1).astype(float)
    return x[np.lexsort((*x.T[::-1], h))]


def _seeds_in_cells(blocks: DataFrame, coarse: np.ndarray, k: int, n: int, seed: int) -> np.ndarray:
    """Seeds of each coarse cell, chosen in a task of its own from a sample in proportion to them."""
    shared = blocks.sparkSession.sparkContext.broadcast(coarse.astype(np.float32))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, spread = np.zeros(len(coarse), np.int64), np.zeros(len(coarse))
        for x, _ in _each(batches):
            cell, distance = nearest_centre(x, shared.value)
            size += np.bincount(cell, minlength=len(size))
            spread += np.bincount(cell, distance ** 2, len(spread))
        at = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(spread[at])], names=["cell", "size", "spread"])

    got = blocks.mapInArrow(measure, "cell long, size long, spread double").groupBy("cell").agg(
        F.sum("size").alias("size"), F.sum("spread").alias("spread")).toArrow()
    size, spread = np.zeros(len(coarse), np.int64), np.zeros(len(coarse))
    size[got.column("cell").to_numpy()] = got.column("size").to_numpy()
    spread[got.column("cell").to_numpy()] = got.column("spread").to_numpy()
    quota = share_seeds(size, spread, min(k, n))
    share = np.minimum(1.0, ROWS_PER_SEED * quota / np.maximum(size, 1))
    chosen = blocks.sparkSession.sparkContext.broadcast(share)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest = chosen.value.max()
        for x, h in _each(batches):
            x, h = x[h <= highest], h[h <= highest]
            cell, _ = nearest_centre(x, shared.value)
            at = h <= chosen.value[cell]
            x, h, cell = x[at], h[at], cell[at]
            order = np.argsort(cell, kind="stable")
            parts = [(c, order[a:b]) for c, a, b in runs(cell[order])]
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array([c for c, _ in parts], pa.int32()),
                "h": pa.array([h[at].tobytes() for _, at in parts], pa.binary()),
                "m": pa.array([x[at].tobytes() for _, at in parts], pa.binary())})

    def seeds(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        h = np.frombuffer(b"".join(group.column("h").to_pylist()))
        x = np.frombuffer(b"".join(group.column("m").to_pylist()), np.float32).reshape(len(h), -1).astype(float)
        x = x[np.lexsort((*x.T[::-1], h))]
        centres = spread_seeds(x, int(quota[cell]), np.random.default_rng([seed, cell]))
        return pa.table({"cell": pa.array([cell], pa.int32()), "m": pa.array([centres.tobytes()], pa.binary())})

    out = (
        blocks.mapInArrow(sample, "cell int, h binary, m binary").groupBy("cell").applyInArrow(seeds, "cell int, m binary")
        .toArrow().sort_by("cell")
    )
    found = np.frombuffer(b"".join(out.column("m").to_pylist())).reshape(-1, coarse.shape[1])
    missing = k - len(found)  # cells whose sample came out empty, or fewer rows than centres
    return np.vstack([found, np.resize(coarse, (missing, coarse.shape[1]))]) if missing > 0 else found


def _pass(blocks: DataFrame, centres: np.ndarray, share: float = 1.0) -> tuple[np.ndarray, float]:
    """(means of the rows nearest to each centre, inertia of the centres given), over a hash share of the rows."""
    k, dim = centres.shape
    shared = blocks.sparkSession.sparkContext.broadcast(Finder(centres.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 2))
        for x in _joined(_each(batches), share):
            number, square = shared.value(x)
            n, sums = _sums(x, number, k)
            total[:, :dim] += sums
            total[:, dim] += n
            total[:, dim + 1] += np.bincount(number, square, k)
        for part in range(0, k, PART):
            own = total[part:part + PART]
            if own[:, dim].any():
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part // PART], pa.int32()), "m": pa.array([own.tobytes()], pa.binary())})

    got = add_payloads(
        blocks.mapInArrow(run, "part int, m binary"), blocks.rdd.getNumPartitions() * k * (dim + 2))
    out, inertia = centres.copy(), 0.0
    for part, total in got.items():
        total = total.reshape(-1, dim + 2)
        own = out[part * PART:part * PART + PART]
        some = total[:, dim] > 0
        own[some] = total[some, :dim] / total[some, dim, None]
        inertia += float(total[:, dim + 1].sum())
    return out, inertia


def _joined(blocks: Iterator[tuple[np.ndarray, np.ndarray]], share: float) -> Iterator[np.ndarray]:
    """The share of the rows, put together to matrices of some size."""
    held: list[np.ndarray] = []
    values = 0
    for x, h in blocks:
        held.append(x if share >= 1.0 else x[h <= share])
        values += held[-1].size
        if values >= 8 * BLOCK_VALUES:
            yield np.concatenate(held)
            held, values = [], 0
    if held:
        yield np.concatenate(held)
