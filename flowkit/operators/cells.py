"""Cells of vectors: the numpy side of exact nearest-neighbour search and of k-means.

A cell is a centre with its members; the triangle inequality rules out whole cells. Everything here
works on one block of rows and on centres of bounded number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLACK = 1e-9  # relative; rounding must never rule out a cell
FEW_DIMS = 8  # vectors that short are compared in one step
PAIRS = 1 << 20  # distances held at once
TILE = 1 << 18  # products worked on while they are in a core's cache


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls as doubles, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(float, copy=False).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all rows of `b`."""
    d = a @ b.T
    d *= -2.0
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None, :]
    return np.maximum(d, 0.0, out=d)


def half_norms(x: np.ndarray) -> np.ndarray:
    """Half of the squared length of each row; x.y less that of y is largest for the nearest y."""
    return 0.5 * np.einsum("ij,ij->i", x, x)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of the nearest centre of each row, in blocks."""
    number, distance, half = np.empty(len(x), np.int64), np.empty(len(x)), half_norms(centres)
    step = max(16, TILE // max(1, len(centres)))
    for a in range(0, len(x), step):
        part = x[a:a + step]
        product = part @ centres.T
        product -= half
        at = product.argmax(1)
        number[a:a + step] = at
        away = part - centres[at]
        distance[a:a + step] = np.sqrt(np.einsum("ij,ij->i", away, away))
    return number, distance


def improve(
    q: np.ndarray, best: np.ndarray, rows: np.ndarray, who: np.ndarray | None = None, first: int = 0,
    half: np.ndarray | None = None,
) -> int:
    """Lower `best`, the distance of each row of `q` to what it has seen, by the given rows.

    `who` gets the number of the row that is now the nearest, counted from `first`; `half` may hold
    the half norms of the rows. With a finite best, a distance over a quarter of the dimensions
    rules out rows before the others are looked at. Returns how many pairs were compared in full.
    """
    done = 0
    half = half_norms(rows) if half is None else half
    head = rows.shape[1] // 4 if rows.shape[1] > FEW_DIMS and np.isfinite(best).all() else 0
    if head and len(rows) > 32:
        low = q[:, :head] @ rows[:, :head].T
        low -= half_norms(rows[:, :head])
        bound = (best * (1.0 + SLACK) + SLACK) ** 2
        number = np.flatnonzero((low > (half_norms(q[:, :head]) - 0.5 * bound - SLACK)[:, None]).any(0))
        rows, half = rows[number], half[number]
    else:
        number = None
    step = max(16, TILE // max(1, len(rows)))
    for a in range(0, len(q) if len(rows) else 0, step):
        part = q[a:a + step]
        product = part @ rows.T
        product -= half
        at = product.argmax(1)
        # the product picks the neighbour, the plain difference gives its distance
        away = part - rows[at]
        distance = np.sqrt(np.einsum("ij,ij->i", away, away))
        now = best[a:a + step]
        if who is not None:
            better = distance < now
            who[a:a + step][better] = first + (at if number is None else number[at])[better]
        np.minimum(now, distance, out=now)
        done += len(part) * len(rows)
    return done


def runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    if not len(sorted_):
        return []
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    return list(zip(sorted_[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(sorted_)]))


class CellIndex:
    """Rows of a size that fits a task, in cells around some of them; exact nearest distances."""

    def __init__(self, rows: np.ndarray, seed: int = 42) -> None:
        self.middle = rows.mean(0)
        x = rows - self.middle
        self.dims = np.argsort(-x.var(0), kind="stable")  # the telling dimensions first
        x = x[:, self.dims]
        k = min(len(x), int(2.0 * np.sqrt(len(x))), 1024)
        centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
        cell, _ = nearest_centre(x, centres)
        size = np.bincount(cell, minlength=k)
        mean = np.zeros_like(centres)
        np.add.at(mean, cell, x)
        self.centres = mean[size > 0] / size[size > 0, None]
        cell, radius = nearest_centre(x, self.centres)
        order = np.lexsort((radius, cell))
        self.x, self.r, self.order = x[order], radius[order], order
        self.half = half_norms(self.x)
        self.start = np.searchsorted(cell[order], np.arange(len(self.centres) + 1))
        self.size = np.diff(self.start)
        self.radius = np.full(len(self.centres), -np.inf)
        np.maximum.at(self.radius, cell, radius)
        self.compared = 0  # pairs compared in full so far

    def _visit(
        self, at: np.ndarray, q: np.ndarray, d: np.ndarray, best: np.ndarray, who: np.ndarray, cell: int
    ) -> None:
        """Let the rows `at` of `q` see the cell; `d` holds their distances to its centre."""
        a, b = self.start[cell], self.start[cell + 1]
        now, number, d = best[at], who[at], d[at]
        if b - a > 32 and np.isfinite(now).all():  # members whose distance to the centre is too different stay out
            reach = now * (1.0 + SLACK) + SLACK
            low, high = np.searchsorted(self.r[a:b], [(d - reach).min(), (d + reach).max()])
            a, b = a + low, a + min(high + 1, b - a)
        self.compared += improve(q[at], now, self.x[a:b], number, a, self.half[a:b])
        best[at], who[at] = now, number

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """Distance of each row to its nearest member."""
        return self.nearest_with_number(rows)[0]

    def nearest_with_number(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance to the nearest member, its position in the rows given)."""
        out, who = np.empty(len(rows)), np.empty(len(rows), np.int64)
        step = max(1, PAIRS // len(self.centres))
        for a in range(0, len(rows), step):
            out[a:a + step], number = self._nearest((rows[a:a + step] - self.middle)[:, self.dims])
            who[a:a + step] = self.order[number]
        return out, who

    def _nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(squared(q, self.centres))
        lower = d - self.radius - SLACK * (1.0 + d)
        lower[:, self.size == 0] = np.inf
        best, who = np.full(len(q), np.inf), np.zeros(len(q), np.int64)
        first = np.where(self.size > 0, d, np.inf).argmin(1)
        for _ in range(3):  # the nearest open cell first, so that the bound is tight for the rest
            rows = np.flatnonzero(lower[np.arange(len(q)), first] < best)
            order = rows[np.argsort(first[rows], kind="stable")]
            for cell, a, b in runs(first[order]):
                at = order[a:b]
                self._visit(at, q, d[:, cell], best, who, cell)
            lower[np.arange(len(q)), first] = np.inf
            first = lower.argmin(1)
        row, cell = np.nonzero(lower < best[:, None])
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        for c, a, b in runs(cell):
            at = row[a:b]
            at = at[lower[at, c] < best[at]]
            if len(at):
                self._visit(at, q, d[:, c], best, who, c)
        return best, who


class CellTree:
    """Centres in two levels: each belongs to the nearest of about sqrt(n) of them.

    `radius` (per centre) and `reach` (per upper centre) are the largest distances of members; they
    are set once the members are known. Placing costs about 2 sqrt(n) distances a row.
    """

    def __init__(self, centres: np.ndarray) -> None:
        n = len(centres)
        upper = centres[: max(1, int(np.sqrt(n)))]
        owner, _ = nearest_centre(centres, upper)
        order = np.argsort(owner, kind="stable")
        self.upper, self.centres, self.owner = upper, centres[order], owner[order]
        self.order = order  # position of each centre in the array given
        self.start = np.searchsorted(self.owner, np.arange(len(upper) + 1))
        self.radius = np.full(n, -np.inf)
        self.reach = np.full(len(upper), -np.inf)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its centre, distance to its upper centre): near, not always nearest."""
        group, up = nearest_centre(x, self.upper)
        cell, distance = np.empty(len(x), np.int64), np.empty(len(x))
        order = np.argsort(group, kind="stable")
        for g, a, b in runs(group[order]):
            at = order[a:b]
            number, distance[at] = nearest_centre(x[at], self.centres[self.start[g]:self.start[g + 1]])
            cell[at] = self.start[g] + number
        return cell, distance, up

    def set_radii(self, cells: np.ndarray, radius: np.ndarray, up: np.ndarray) -> None:
        """Largest member distances per cell that has members."""
        self.radius[cells] = radius
        np.maximum.at(self.reach, self.owner[cells], up)

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that may hold a member closer to the row than its bound."""
        d = np.sqrt(squared(x, self.upper))
        row, group = np.nonzero(d - self.reach - SLACK * (1.0 + d) < bound[:, None])
        order = np.argsort(group, kind="stable")
        row, group = row[order], group[order]
        rows, cells = [], []
        for g, a, b in runs(group):
            at, low = row[a:b], self.start[g]
            d = np.sqrt(squared(x[at], self.centres[low:self.start[g + 1]]))
            r, c = np.nonzero(d - self.radius[low:self.start[g + 1]] - SLACK * (1.0 + d) < bound[at, None])
            rows.append(at[r])
            cells.append(c + low)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(cells)
