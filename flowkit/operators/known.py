"""Admission against large known tables by a Bloom filter, exact in its results.

The filter over the row keys of all known rows is built by the executors, chunk by chunk, and has a
bounded size, so it can be broadcast. Candidates that it does not know are new for certain; only the
others meet the known tables, which are scanned for their keys and not shuffled. Rows accepted later
are added to the filter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.functions import col, row_key
from flowkit.operators.dedup import exclude_known
from flowkit.staging import LOOKUP_ROWS, stage

BITS_PER_ROW = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27  # 8 KB to 16 MB
HASHES = 5
CHUNK = 1 << 13  # bytes of the filter that are put together by one task


def bit_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES positions of each 64-bit key (double hashing), one row per hash."""
    z = keys.astype(np.int64).view(np.uint64)
    step = ((z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return np.stack([(z + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


class KnownRows:
    """Known tables and the filter over their feature tuples."""

    def __init__(self, tables: Sequence[DataFrame], features: Sequence[str]) -> None:
        self.features = list(features)
        self.tables = [t.select(*[col(f) for f in features]) for t in tables]
        rows = sum(t.count() for t in self.tables)
        size = int(np.clip(BITS_PER_ROW * rows, LEAST_BITS, MOST_BITS))
        self.bits = -(-size // (8 * CHUNK)) * 8 * CHUNK
        self.filter = np.zeros(self.bits // 8, np.uint8)
        for t in self.tables:
            self._enter(t)

    def _enter(self, table: DataFrame) -> None:
        bits = self.bits

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits, bool)
            for batch in batches:
                own[bit_positions(batch.column(0).to_numpy(), bits).ravel()] = True
            packed = np.packbits(own).reshape(-1, CHUNK)
            some = np.flatnonzero(packed.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([packed[c].tobytes() for c in some], pa.binary())], names=["part", "m"])

        def merge(group: pa.Table) -> pa.Table:
            total = np.zeros(CHUNK, np.uint8)
            for m in group.column("m"):
                total |= np.frombuffer(m.as_buffer(), np.uint8)
            return pa.table({"part": group.column("part").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

        keys = table.select(row_key(self.features).alias("k"))
        got = keys.mapInArrow(mark, "part int, m binary").groupBy("part").applyInArrow(merge, "part int, m binary").toArrow()
        for part, m in zip(got.column("part").to_pylist(), got.column("m")):
            self.filter[part * CHUNK:(part + 1) * CHUNK] |= np.frombuffer(m.as_buffer(), np.uint8)

    def add(self, table: DataFrame) -> None:
        """Further known rows, as a written table."""
        rows = table.select(*[col(f) for f in self.features])
        self.tables.append(rows)
        self._enter(rows)

    def exclude(self, candidates: DataFrame) -> DataFrame:
        """The candidates whose feature tuple is in no known table (null features match nothing)."""
        shared, bits = candidates.sparkSession.sparkContext.broadcast(self.filter), self.bits

        @F.pandas_udf("boolean")
        def maybe(keys: pd.Series) -> pd.Series:
            known = np.ones(len(keys), bool)
            for at in bit_positions(keys.to_numpy(), bits):
                known &= shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
            return pd.Series(known)

        marked = stage(candidates.withColumn("__maybe__", maybe(row_key(self.features))))
        new, hits = (marked.where(w).drop("__maybe__") for w in ("not __maybe__", "__maybe__"))
        keys = hits.select(row_key(self.features).alias("__k__")).distinct()
        few = keys.count()
        if not few:
            return new
        keys = F.broadcast(keys) if few <= LOOKUP_ROWS else keys
        met = reduce(DataFrame.unionByName, self.tables).withColumn("__k__", row_key(self.features))
        met = met.join(keys, "__k__", "left_semi").drop("__k__")
        return new.unionByName(exclude_known(hits, met, self.features))
