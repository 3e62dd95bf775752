"""Distributed farthest-first selection: rows that cover a table with the smallest radius.

A round measures the distance of every row to what has been chosen (an index of cells, broadcast)
and lets each task propose its farthest rows, apart from each other. The driver accepts, farthest
first, the proposals that are at least `KEPT` of the largest distance away from everything chosen.
So all chosen rows lie at least that far apart, and the covering radius is at most 2 / KEPT times the
smallest possible one. Only proposals travel; the table is read once a round and never rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.operators.cells import CellIndex, matrix

KEPT = 0.8
PROPOSALS = 256  # of one task and round


def spread_out(x: np.ndarray, d: np.ndarray, most: int, low: float) -> np.ndarray:
    """Farthest-first among the rows whose distances so far are `d`, while those are above `low`."""
    d, out = d.copy(), []
    while len(out) < min(most, len(x)):
        at = int(d.argmax())
        if d[at] <= low:
            break
        out.append(at)
        away = x - x[at]
        np.minimum(d, np.sqrt(np.einsum("ij,ij->i", away, away)), out=d)
    return np.array(out, np.int64)


def _proposals(rows: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, number, vector) of the rows that tasks propose, farthest first."""
    shared = rows.sparkSession.sparkContext.broadcast(CellIndex(chosen) if len(chosen) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        d, number, x = np.zeros(0), np.zeros(0, np.int64), None
        for batch in batches:
            if not len(batch):
                continue
            v = matrix(batch.column(1))
            own = index.nearest(v) if index else np.full(len(v), np.inf)
            at = np.flatnonzero(own >= KEPT * max(own.max(), d.max(initial=0.0)))
            x = v[at] if x is None else np.concatenate([x, v[at]])
            d, number = np.concatenate([d, own[at]]), np.concatenate([number, batch.column(0).to_numpy()[at]])
            top = d.max()
            best = spread_out(x, d, PROPOSALS, KEPT * top if np.isfinite(top) else 0.0)
            d, number, x = d[best], number[best], x[best]
        if len(d):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d.tobytes()], pa.binary()), pa.array([number.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                names=["d", "k", "m"])

    got = rows.mapInArrow(run, "d binary, k binary, m binary").toArrow()
    d = np.frombuffer(b"".join(got.column("d").to_pylist()))
    number = np.frombuffer(b"".join(got.column("k").to_pylist()), np.int64)
    x = np.frombuffer(b"".join(got.column("m").to_pylist())).reshape(len(d), -1) if len(d) else np.zeros((0, 0))
    order = np.lexsort((number, -d))
    return d[order], number[order], x[order]


def farthest_first(rows: DataFrame, chosen: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, gaps) of up to `need` rows of a written table (k long, v array<double>).

    `chosen` holds the vectors that count as chosen already. A gap is the distance of a row to all
    chosen before it; the first row of an empty selection has an infinite one. Ends early when every
    row lies on a chosen one.
    """
    numbers: list[int] = []
    gaps: list[float] = []
    while len(numbers) < need:
        d, number, x = _proposals(rows, chosen)
        if not len(d) or d[0] <= 0.0:
            break
        low, new = KEPT * d[0], []
        for i in range(len(d)):
            gap = d[i]
            if new:
                away = np.array([x[j] for j in new]) - x[i]
                gap = min(gap, float(np.sqrt((away * away).sum(1).min())))
            if len(numbers) < need and (gap >= low if np.isfinite(low) else not new):
                new.append(i)
                numbers.append(int(number[i]))
                gaps.append(float(gap))
        chosen = np.concatenate([chosen, x[new]]) if len(chosen) else x[new]
    return np.array(numbers, np.int64), np.array(gaps)


def numbered(df: DataFrame, vector) -> DataFrame:
    """(k, v) next to the columns, for a table that is then written."""
    return df.withColumn("__k__", F.monotonically_increasing_id()).withColumn("__v__", vector.cast("array<double>"))
