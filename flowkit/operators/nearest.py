"""Nearest-neighbour distance between two row sets, exact at any size.

Both ways search in two steps: the own cell of a row gives a distance, and only cells that the
triangle inequality leaves below it are visited then (see `cells`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkit.functions import col, order_hash
from flowkit.operators.cells import PAIRS, CellIndex, CellTree, improve, matrix, runs
from flowkit.operators.ranking import hash_take
from flowkit.staging import lookup, stage

BROADCAST_VALUES = 8_000_000  # 64 MB of doubles: right sides that travel whole, and centres of cells
CELL_ROWS = 1024  # right rows a cell holds on average
PACKED = 1024  # left rows per travelling block
BLOCKS = 16  # left blocks of a cell that meet it in one task
OPENED = 1 << 22  # bytes of left rows that leave a task for further cells in one batch


def nearest_distance(
    left: DataFrame, right: DataFrame, ids: Sequence[str], vector: str = "features",
    name: str = "dist", broadcast_values: int = BROADCAST_VALUES,
) -> DataFrame:
    """Add to each left row the Euclidean distance to its nearest right row.

    A right side within the size bound is sent to every task as an index of cells; a larger one
    is partitioned by cells, see `_nearest_by_cells`. Without right rows the distance is null.
    """
    probe = right.select(F.size(col(vector)).alias("d")).first()
    if probe is None:
        return left.withColumn(name, F.lit(None).cast("double"))
    if right.count() * max(1, probe["d"]) > broadcast_values:
        return _nearest_by_cells(left, right, vector, name, broadcast_values)
    rows = right.select(col(vector).cast("array<double>").alias("v")).distinct().toArrow()
    index = left.sparkSession.sparkContext.broadcast(CellIndex(matrix(rows.column("v"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(batch.num_columns - 1))
            near = index.value.nearest(rows) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(near)], names=[*batch.schema.names[:-1], name])

    schema = T.StructType([*left.schema.fields, T.StructField(name, T.DoubleType())])
    return left.withColumn("__v__", col(vector).cast("array<double>")).mapInArrow(score, schema)


def _pack(key: str | None, rows: int):
    """Blocks of up to `rows` neighbouring rows of one cell: (cell, m bytes, and k bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, v = batch.column("cell").to_numpy(), matrix(batch.column("v"))
            keys = batch.column(key).to_numpy() if key else None
            out = [(c, i, min(i + rows, b)) for c, a, b in runs(cell) for i in range(a, b, rows)]
            columns = {
                "cell": pa.array([c for c, _, _ in out], pa.int32()),
                "m": pa.array([v[a:b].tobytes() for _, a, b in out], pa.binary()),
            }
            if key:
                columns["k"] = pa.array([keys[a:b].tobytes() for _, a, b in out], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _salted(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with a `salt`, number of salts per cell): a cell with many blocks gets several tasks."""
    counts = blocks.groupBy("cell").agg(F.ceil(F.count("*") / BLOCKS).cast("int").alias("salts"))
    counts = stage(counts)
    hot = counts.where("salts > 1")
    marked = lookup(blocks, hot, ["cell"], "left")
    salt = F.pmod(F.xxhash64("m"), F.coalesce("salts", F.lit(1))).cast("int")
    return marked.withColumn("salt", salt).drop("salts"), counts


def _meet(left_blocks: DataFrame, right_blocks: DataFrame, run, schema: str) -> DataFrame:
    """Each group of left blocks of a cell with the right blocks of the cell."""
    left, counts = _salted(left_blocks)
    copies = right_blocks.join(counts, "cell").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.groupBy("cell", "salt").cogroup(copies.groupBy("cell", "salt")).applyInArrow(run, schema)


def _nearest_by_cells(
    left: DataFrame, right: DataFrame, vector: str, name: str, broadcast_values: int
) -> DataFrame:
    """Exact nearest distance with both sides partitioned by cells.

    Some right rows are centres, about one for CELL_ROWS rows while the centres stay within the
    size bound; each right row belongs to a near centre. A left row meets the cell of its own near
    centre first. The distance found there bounds the cells it has to visit: those whose centre is
    closer than distance plus radius. Left rows travel in blocks of bounded size; a cell that many
    left rows visit is copied to several tasks.
    """
    spark = left.sparkSession
    # copies of a vector do not change a distance
    right = right.select(col(vector).cast("array<double>").alias("v")).distinct()
    right = stage(right.withColumn("h", order_hash(0, [F.xxhash64("v")])))
    dim = len(right.first()["v"])
    most = max(1, broadcast_values // max(1, dim))
    n_cells = int(np.clip(right.count() // CELL_ROWS, 1, most))
    centres = hash_take(right, [], ["h"], 0, n_cells).select("v", "h").toArrow().sort_by("h")
    tree = CellTree(matrix(centres.column("v")))
    shared = spark.sparkContext.broadcast(tree)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, r, up = shared.value.place(matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(r), pa.array(up)],
                names=[*batch.schema.names, "cell", "r", "up"])

    placed = stage(right.mapInArrow(to_cells, "v array<double>, h string, cell int, r double, up double"))
    radii = placed.groupBy("cell").agg(F.max("r").alias("r"), F.max("up").alias("up")).toArrow()
    tree.set_radii(*(radii.column(c).to_numpy() for c in ("cell", "r", "up")))
    shared = spark.sparkContext.broadcast(tree)
    right_blocks = stage(
        placed.select("cell", "v", "h").repartitionByRange("cell", "h").sortWithinPartitions("cell")
        .mapInArrow(_pack(None, CELL_ROWS), "cell int, m binary"))

    # a row number travels instead of the ids, which may be null, repeated or of any type
    number = "__left__"
    left = stage(left.withColumn(number, F.monotonically_increasing_id()))
    keys = left.select(F.col(number).alias("k"), col(vector).cast("array<double>").alias("v"))

    def own_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _, _ = shared.value.place(matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32))], names=["k", "v", "cell"])

    left_blocks = stage(
        keys.mapInArrow(own_cell, "k long, v array<double>, cell int")
        .repartitionByRange(F.col("cell"), F.xxhash64("k")).sortWithinPartitions("cell")
        .mapInArrow(_pack("k", PACKED), "cell int, m binary, k binary"))

    def rows_of(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, dim)

    def first_visit(near: pa.Table, members: pa.Table) -> pa.Table:
        """The distance within the own cell."""
        bests, other = [], rows_of(members.column("m"))
        for m in near.column("m"):
            x = np.frombuffer(m.as_buffer()).reshape(-1, dim)
            best = np.full(len(x), np.inf)
            improve(x, best, other)
            bests.append(best.tobytes())
        return near.select(["cell", "k", "m"]).append_column("best", pa.array(bests, pa.binary()))

    seen = stage(_meet(left_blocks, right_blocks, first_visit, "cell int, k binary, m binary, best binary"))

    def blocks(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"cell": pa.int32(), "k": pa.binary(), "best": pa.binary(), "m": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks for the cells still open, in a stream: a row may have to visit many."""
        step = max(1, PAIRS // n_cells)
        out, size = [], 0
        for batch in batches:
            for own, k, m, best in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                k, x, best = np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(m.as_buffer()), np.frombuffer(best.as_buffer())
                x = x.reshape(-1, dim)
                for low in range(0, len(x), step):
                    row, cell = shared.value.within(x[low:low + step], best[low:low + step])
                    order = np.argsort(cell, kind="stable")
                    row, cell = row[order] + low, cell[order]
                    for c, a, b in runs(cell):
                        if c == own:
                            continue
                        at = row[a:b]
                        out.append((c, k[at].tobytes(), best[at].tobytes(), x[at].tobytes()))
                        size += x[at].nbytes
                        if size > OPENED:
                            yield blocks(out)
                            out, size = [], 0
        if out:
            yield blocks(out)

    opened = stage(seen.select("cell", "k", "m", "best").mapInArrow(
        open_cells, "cell int, k binary, best binary, m binary"))

    def next_visit(near: pa.Table, members: pa.Table) -> pa.Table:
        ks, bests = [], []
        other = rows_of(members.column("m"))
        for m, k, best in zip(*(near.column(c).to_pylist() for c in ("m", "k", "best"))):
            now = np.frombuffer(best).copy()
            improve(np.frombuffer(m).reshape(-1, dim), now, other)
            ks.append(k)
            bests.append(now.tobytes())
        return pa.table({"k": pa.array(ks, pa.binary()), "best": pa.array(bests, pa.binary())})

    later = _meet(opened, right_blocks, next_visit, "k binary, best binary")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.frombuffer(b"".join(batch.column("k").to_pylist()), np.int64)
            best = np.frombuffer(b"".join(batch.column("best").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(best)], names=["k", name])

    best = (
        seen.select("k", "best").unionByName(later)
        .mapInArrow(spread, f"k long, `{name}` double")
        .groupBy("k").agg(F.min(col(name)).alias(name)).withColumnRenamed("k", number)
    )
    return left.join(best, number, "left").drop(number)
