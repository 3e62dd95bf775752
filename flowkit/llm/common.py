"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
# ASCII lower case only, other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; `bytes.split` cuts at exactly \\x20 and \\x09-\\x0D."""
    return text.encode().translate(LOWER).split() if text else []


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, also where `use` needs it in a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def release_memory() -> None:
    """Give freed memory of a long-lived Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for `mapInArrow` that releases its memory when the partition is done."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes, given links i[k] - j[k]."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (u, v): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps as joins with per-node minima, so that a node with
    very many neighbours is never gathered. Each round is written to the shared folder; it ends
    when every edge points from a node to a root. No edges give no rows.
    """
    stars = stage(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        below = stars.select("v").join(stars.select(F.col("u").alias("v")), "v", "left_semi")
        if below.isEmpty() and stars.groupBy("u").count().where("count > 1").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                stars.select("v", F.col("v").alias("r")).distinct())
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
