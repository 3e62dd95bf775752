"""Embedding whitening: block QR, Householder bidiagonal form, dqds singular values, twisted directions.

The rows, centred exactly in integers, are reduced to triangular factors block by block and the
factors to one by a tree of bounded fan-in. The driver sees that one triangle only, whose size is
the square of the vector length: it becomes upper bidiagonal, dqds finds its singular values, and
twisted factorisations find the directions. Rows are then whitened in a map over the table.

A vector that is null, empty, shorter than the longest one, or holds null or non-finite entries
takes no part. Repeated vectors count once in the fit and get one result per row; rows with a null
or repeated id are rows like any other. Components whose variance vanishes next to the largest are
left out, as nothing can be divided by it: a table of one distinct vector, or of none, gives no
rows. Equal variances are given an orthonormal basis of their common space. A deviation that a long
cannot hold (from some ten million distinct vectors on) is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import tidy
from flowkit.staging import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
FAN_BYTES = 1 << 25  # of factors that meet in one task, or on the driver
EPS = np.finfo(float).eps
LONG = float(np.iinfo(np.int64).max)


# ---- linear algebra of one small matrix ---------------------------------------------------------

def bidiagonalize(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) with r = u B w', B upper bidiagonal with diagonal a and b above it."""
    a, d = np.array(r, float), r.shape[0]
    w = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        norm = np.linalg.norm(x)
        v = x.copy()
        if norm == 0.0:
            return v, 0.0
        v[0] += np.copysign(norm, x[0])
        return v, 2.0 / (v @ v)

    for k in range(d):
        v, t = reflector(a[k:, k])
        a[k:, k:] -= t * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, t = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= t * np.outer(a[k:, k + 1:] @ v, v)
            w[:, k + 1:] -= t * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal (a, b), largest first.

    The qd array is swept with shifts that stay below its smallest value; a shift that turns out
    too large is undone and reduced. Values leave the array at its end, off-diagonals that have
    vanished split it.
    """
    out: list[float] = []
    open_ = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    while open_:
        q, e, sigma = open_.pop()
        shift = 0.0
        while q:
            n = len(q)
            if n == 1:
                out.append(q.pop() + sigma)
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (sigma + q[i] + q[i + 1])), -1)
            if cut == n - 2:
                out.append(q.pop() + sigma)
                e.pop()
                continue
            if cut >= 0:
                open_.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if n == 2:
                half = (q[0] + q[1] + e[0]) / 2.0
                big = half + np.hypot((q[0] - q[1] - e[0]) / 2.0, np.sqrt(q[0] * e[0]))
                out += [big + sigma, (q[0] * q[1] / big if big else 0.0) + sigma]
                break
            if q[0] < q[-1]:  # graded the other way round: the same values, read from the other end
                flipped = _flip(q, e)
                if flipped is not None:
                    q, e = flipped
            while True:
                swept = _sweep(q, e, shift)
                if swept is not None:
                    break
                shift = shift / 4.0 if shift > EPS * sigma else 0.0
            q, e, least, last = swept
            sigma += shift
            # `least` bounds the smallest value from above; close to it once the end has converged
            gap = e[-1] if e else 0.0
            shift = max(0.0, least - 2.0 * np.sqrt(gap * max(last, 0.0)) - gap) if least == last else least / 4.0
    return np.array(sorted(out, reverse=True))


def _flip(q: list[float], e: list[float]) -> tuple[list[float], list[float]] | None:
    """The qd array of the matrix read backwards; None where a zero stands in the way."""
    back, d = [], q[-1]
    up: list[float] = []
    for k in range(len(q) - 1, 0, -1):
        # one zero-shift sweep in reverse order gives the reversed factorisation
        total = d + e[k - 1]
        if total == 0.0:
            return None
        back.append(total)
        up.append(q[k - 1] * e[k - 1] / total)
        d = q[k - 1] * d / total
    back.append(d)
    return back, up


def _sweep(q: list[float], e: list[float], shift: float):
    """One dqds transform: (q, e, smallest d, last d), or None if the shift is too large."""
    new_q, new_e = [], []
    d = q[0] - shift
    least = d
    for k in range(len(e)):
        if d < 0.0:
            return None
        total = d + e[k]
        if total == 0.0:
            new_q.append(0.0)
            new_e.append(0.0)
            d = q[k + 1] - shift
        else:
            new_q.append(total)
            ratio = q[k + 1] / total
            new_e.append(e[k] * ratio)
            d = d * ratio - shift
        least = min(least, d)
    if d < 0.0:
        return None
    new_q.append(d)
    return new_q, new_e, least, d


def twisted_directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B for its eigenvalues `values` (falling), one per column."""
    d = len(a)
    q, e, off = a * a, b * b, a[:-1] * b
    tiny = max(float(values[0]) if len(values) else 0.0, 1e-300) * EPS * EPS
    out = np.zeros((d, len(values)))

    def nonzero(x: float) -> float:
        return x if abs(x) > tiny else tiny

    for j, value in enumerate(values):
        down, s = np.empty(d), np.empty(d)  # factors from the top
        s[0] = -value
        for i in range(d):
            down[i] = nonzero(s[i] + q[i])
            if i < d - 1:
                s[i + 1] = e[i] * s[i] / down[i] - value
        up, p = np.empty(d), np.empty(d)  # factors from the bottom; up[i] belongs to row i
        p[-1] = q[-1] - value
        for i in range(d - 1, 0, -1):
            up[i] = nonzero(p[i] + e[i - 1])
            p[i - 1] = q[i - 1] * p[i] / up[i] - value
        gamma = np.abs(s + p + value)
        first = j
        while first > 0 and values[first - 1] - value <= 1e-5 * values[0]:
            first -= 1
        near = out[:, first:j]
        best, best_left = out[:, j], 0.0
        for k in np.argsort(gamma, kind="stable")[: 1 if first == j else d]:
            z = np.zeros(d)
            z[k] = 1.0
            for i in range(k - 1, -1, -1):
                z[i] = -off[i] / down[i] * z[i + 1]
            for i in range(k, d - 1):
                z[i + 1] = -off[i] / up[i + 1] * z[i]
            z /= np.linalg.norm(z)
            left = z - near @ (near.T @ z)
            left -= near @ (near.T @ left)
            size = float(np.linalg.norm(left))
            if size > best_left:
                best, best_left = left / size, size
            if size > 0.1:
                break
        out[:, j] = best
    return out


def principal_directions(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues of r'r, unit directions as columns, trace); only values that do not vanish."""
    size = np.abs(r).max(initial=0.0)
    if not size:
        return np.zeros(0), np.zeros((r.shape[0], 0)), 0.0
    a, b, w = bidiagonalize(r / size)
    values = dqds(a, b)
    kept = values[:most][values[:most] > len(values) * EPS * values[0]]
    z = w @ twisted_directions(a, b, kept)
    z *= np.where(z[np.abs(z).argmax(0), np.arange(z.shape[1])] < 0.0, -1.0, 1.0)
    return kept * size ** 2, z, float((r ** 2).sum())


# ---- Spark --------------------------------------------------------------------------------------

def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as longs floor(64 c), without the constant shift."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch.column(0), d)
        for k in range(0, len(x), BLOCK_ROWS):
            yield x[k:k + BLOCK_ROWS]


def tree_reduce(parts: DataFrame, combine: Callable[[list[bytes]], bytes], size: int) -> bytes | None:
    """Combine the payloads of (part int, payload binary), at most FAN_BYTES of them in one place."""
    fan = max(2, FAN_BYTES // max(1, size))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.sort_by("part")
        part = rows.column("part")[0].as_py() // fan
        return pa.table({"part": pa.array([part], pa.int32()),
                         "payload": pa.array([combine(rows.column("payload").to_pylist())], pa.binary())})

    parts = stage(parts)
    highest = parts.agg(F.max("part")).first()[0]
    while highest is not None and highest >= fan:
        parts = stage(parts.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merge, parts.schema))
        highest //= fan
    left = parts.orderBy("part").toArrow().column("payload").to_pylist()
    return combine(left) if left else None


def _partition_payloads(fit: DataFrame, d: int, start: Callable[[], object],
                        step: Callable[[object, np.ndarray], object], dump: Callable[[object], bytes]) -> DataFrame:
    """One payload per partition of the fit list, folded block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = start(), False
        for x in _blocks(batches, d):
            state, seen = step(state, x), True
        if seen:
            yield pa.record_batch([pa.array([dump(state)], pa.binary())], ["payload"])

    return fit.select("x").mapInArrow(tidy(run), "payload binary").select(
        F.spark_partition_id().alias("part"), "payload")


def _stack(factors: list[bytes], d: int) -> bytes:
    """One triangle for several: QR of the factors one above the other."""
    r = np.zeros((0, d))
    for f in factors:
        r = np.linalg.qr(np.vstack([r, np.frombuffer(f).reshape(-1, d)]), mode="r")
    return r.tobytes()


def _pool(parts: list[bytes], m: int) -> bytes:
    """Count, mean and centred products of all parts together."""
    n, mean, products = 0.0, np.zeros(m), np.zeros((m, m))
    for part in parts:
        row = np.frombuffer(part)
        k, other, own = row[0], row[1:m + 1], row[m + 1:].reshape(m, m)
        shift = other - mean
        products = products + own + np.outer(shift, shift) * (n * k / (n + k))
        mean = mean + shift * (k / (n + k))
        n += k
    return np.concatenate([[n], mean, products.ravel()]).tobytes()


class Whitening:
    """Fitted whitening: n, sums S without the shift, eigenvalues, directions, trace, identity error."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, directions: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.values, self.directions, self.trace = n, sums, values, directions, trace
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return self.n * x - self.sums

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / float(self.n)) @ self.directions / np.sqrt(self.values)


def fit_whitening(rows: DataFrame, most: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """Fit on each distinct vector x of `rows` once: (model or None without rows, vector length)."""
    spark = rows.sparkSession
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return None, 0
    fit = stage(rows.where(F.size("x") == d).groupBy("x").agg(F.lit(1).alias("one")).select("x"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for x in _blocks(batches, d):
            n, total = n + len(x), total + x.sum(0)
        yield pa.record_batch(
            [pa.array(np.arange(-1, d)), pa.array(np.concatenate([[n], total]))], ["dim", "total"])

    sums = (
        fit.mapInArrow(tidy(add), "dim long, total long").groupBy("dim").agg(F.sum("total").alias("total")).toArrow()
    )
    total = np.zeros(d + 1, np.int64)
    total[sums.column("dim").to_numpy() + 1] = sums.column("total").to_numpy()
    n, total = int(total[0]), total[1:]

    def fold(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, (n * x - total) / float(n)]), mode="r")

    factors = _partition_payloads(fit, d, lambda: np.zeros((0, d)), fold, lambda r: r.tobytes())
    r = np.frombuffer(tree_reduce(factors, lambda parts: _stack(parts, d), 8 * d * d)).reshape(-1, d)
    square = np.zeros((d, d))
    square[:len(r)] = r
    values, directions, trace = principal_directions(square, most)
    model = Whitening(n, total, values / n, directions, trace / n)
    m = len(values)
    if m:
        shared = spark.sparkContext.broadcast(model)

        def products(state: list[bytes], x: np.ndarray) -> list[bytes]:
            z = shared.value.apply(x)
            mean = z.mean(0)
            own = np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()]).tobytes()
            return [_pool([*state, own], m)]

        parts = _partition_payloads(fit, d, list, products, lambda s: s[0])
        pooled = np.frombuffer(tree_reduce(parts, lambda p: _pool(p, m), 8 * (m + 1) ** 2))
        model.identity_error = float(np.abs(pooled[m + 1:].reshape(m, m) / n - np.eye(m)).max())
    return model, d


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = scaled(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    model, d = fit_whitening(rows, most)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    m = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), d)
            k, away = len(x), fitted.centred(x)
            fits = (away.astype(float) ** 2).sum(1) < LONG * (1 - 1e-9)
            deviation = pa.array(np.where(fits, (away * away).sum(1), 0), mask=~fits)
            row = pa.array(np.repeat(np.arange(k), m))
            yield pa.record_batch([
                batch.column(0).take(row), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                pa.array(np.full(k * m, fitted.n)), deviation.take(row), pa.array(fitted.apply(x).ravel()),
                pa.array(np.tile(fitted.values / fitted.trace, k)), pa.array(np.full(k * m, fitted.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(tidy(run), schema)
