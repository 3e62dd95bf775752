"""SimHash near-duplicates: a binary trie of the fingerprints joined with itself.

Equal fingerprints are merged first. The trie is cut into leaves of bounded size; pairs of nodes
are then followed level by level from (root, root), adding up differing bits, and a pair is
dropped once it exceeds the error budget. Each surviving pair of leaves is one row that holds two
bounded arrays; a task follows the same pairs of nodes below the leaves down to single
fingerprints. Links leave a task as a spanning forest, never as all pairs.

Null text counts as empty; an empty text has fingerprint zero. Equal rows share a fingerprint and
each keeps its row. A null doc_id never becomes a component id unless the whole component has none.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import components, free_name, local_roots, tidy, words
from flowkit.staging import stage

SHINGLE = 3
ERRORS = 2
LEAF = 4096
STEP = 2
BITS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 (seed 42) of all shingles; fewer words form one shingle."""
    w = words(text)
    if not w:
        return 0
    if len(w) <= shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[k:] for k in range(shingle))))
    n = max(1, len(w) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(
                (fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, fp long")


def trie_links(
    a: np.ndarray, b: np.ndarray, depth: int, error: int, same: bool, budget: int = ERRORS
) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with at most `budget` differing bits between two sorted uint64 arrays.

    All of `a` share their first `depth` bits, and so do all of `b`; these prefixes differ in
    `error` bits. `same` says that both are one array; then i < j.
    """
    state = np.array([[0], [len(a)], [0], [len(b)], [error]], np.int64)
    found_i, found_j = [], []

    def verify(s: np.ndarray) -> None:
        for da in range(int((s[1] - s[0]).max(initial=0))):
            for db in range(int((s[3] - s[2]).max(initial=0))):
                i, j = s[0] + da, s[2] + db
                ok = (i < s[1]) & (j < s[3])
                i, j = i[ok], j[ok]
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    near &= i < j
                found_i.append(i[near])
                found_j.append(j[near])

    for bit in range(depth, BITS):
        few = (state[1] - state[0] <= 3) & (state[3] - state[2] <= 3)
        verify(state[:, few])
        state = state[:, ~few]
        if not state.shape[1]:
            break
        shift = np.uint64(BITS - 1 - bit)
        ca = np.concatenate(([0], np.cumsum((a >> shift) & np.uint64(1), dtype=np.int64)))
        cb = np.concatenate(([0], np.cumsum((b >> shift) & np.uint64(1), dtype=np.int64)))
        alo, ahi, blo, bhi, e = state
        amid = ahi - (ca[ahi] - ca[alo])
        bmid = bhi - (cb[bhi] - cb[blo])
        twin = (alo == blo) & (ahi == bhi) if same else np.zeros(len(e), bool)
        parts = []
        for x0, x1, y0, y1, more, skip in (
            (alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None),
            (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, twin),
        ):
            ok = (x0 < x1) & (y0 < y1) & (e + more <= budget)
            if skip is not None:
                ok &= ~skip
            parts.append(np.stack([x0[ok], x1[ok], y0[ok], y1[ok], e[ok] + more]))
        state = np.concatenate(parts, axis=1)
    else:
        verify(state)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(a: np.ndarray, b: np.ndarray, depth: int, error: int, same: bool, budget: int):
    """Edges from fingerprints to the first one of their group, for one pair of leaves."""
    a = np.sort(a.view(np.uint64))
    b = a if same else np.sort(b.view(np.uint64))
    i, j = trie_links(a, b, depth, error, same, budget)
    values = a if same else np.concatenate([a, b])
    root = local_roots(len(values), i, j if same else j + len(a))
    child = np.flatnonzero(root != np.arange(len(root)))
    return values[child].view(np.int64), values[root[child]].view(np.int64)


def _prefix(fp, depth: int):
    """The first `depth` bits as a number."""
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("long")


def _leaves(distinct: DataFrame, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves (node, depth, fps array) of at most `leaf` fingerprints, and the nodes by level."""
    rest, depth, leaves, levels = distinct, 0, None, []
    while True:
        nodes = stage(
            rest.groupBy(_prefix(F.col("fp"), depth).alias("node")).agg(F.count("*").alias("n"))
            .withColumn("open", F.col("n") > leaf if depth < BITS else F.lit(False)))
        levels.append(nodes)
        placed = rest.withColumn("node", _prefix(F.col("fp"), depth))
        closed = (
            placed.join(nodes.where("not open").select("node"), "node", "left_semi")
            .select("fp", "node", F.lit(depth).alias("depth"))
        )
        leaves = closed if leaves is None else leaves.union(closed)
        if nodes.where("open").isEmpty():
            break
        rest = placed.join(nodes.where("open").select("node"), "node", "left_semi").select("fp")
        rest = stage(rest)
        depth += STEP
    return stage(leaves.groupBy("node", "depth").agg(F.collect_list("fp").alias("fps"))), levels


def _leaf_pairs(levels: list[DataFrame], budget: int) -> DataFrame:
    """Pairs of leaves whose prefixes differ in at most `budget` bits: the traversal by levels.

    A pair of nodes moves down until both are leaves; a leaf waits for the other side, and only
    the bits of their common depth count.
    """
    live = levels[0].select(
        F.col("node").alias("a"), F.lit(0).alias("da"), F.col("open").alias("oa"),
        F.col("node").alias("b"), F.lit(0).alias("db"), F.col("open").alias("ob"))
    done = []
    for level in range(len(levels)):
        done.append(live.where("not oa and not ob"))
        if level + 1 == len(levels):
            break
        depth = level * STEP
        below = levels[level + 1].select(
            F.shiftrightunsigned("node", STEP).alias("up"), F.col("node").alias("down"), "open")
        live = live.where("oa or ob")
        for x in "ab":
            moved = (
                live.where(f"o{x}").join(below, F.col(x) == F.col("up"))
                .withColumn(x, F.col("down")).withColumn(f"d{x}", F.lit(depth + STEP))
                .withColumn(f"o{x}", F.col("open")).select("a", "da", "oa", "b", "db", "ob"))
            live = moved.union(live.where(f"not o{x}"))
        common = F.least("da", "db")
        wrong = F.bit_count(
            F.expr("shiftrightunsigned(a, da - least(da, db))").bitwiseXOR(
                F.expr("shiftrightunsigned(b, db - least(da, db))")))
        first = F.when(F.col("da") == F.col("db"), F.col("a") <= F.col("b")).otherwise(F.lit(True))
        live = stage(live.where((common >= 0) & (wrong <= budget) & first))
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.union(more)
    return pairs.select("a", "da", "b", "db")


def links_forest(distinct: DataFrame, budget: int = ERRORS, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) that connect exactly what links of at most `budget` bits connect."""
    leaves, levels = _leaves(distinct, leaf)
    pairs = _leaf_pairs(levels, budget)
    joined = (
        pairs.join(leaves.select(F.col("node").alias("a"), F.col("depth").alias("da"),
                                 F.col("fps").alias("fa")), ["a", "da"])
        .join(leaves.select(F.col("node").alias("b"), F.col("depth").alias("db"),
                            F.col("fps").alias("fb")), ["b", "db"])
        .select("a", "da", "fa", "b", "db", "fb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, da, b, db = (batch.column(c)[k].as_py() for c in (0, 1, 3, 4))
                fa, fb = (np.array(batch.column(c)[k].values.to_numpy()) for c in (2, 5))
                depth = min(da, db)
                mask = (1 << depth) - 1
                error = (((a >> (da - depth)) ^ (b >> (db - depth))) & mask).bit_count()
                u, v = _forest(fa, fb, depth, error, (a, da) == (b, db), budget)
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return joined.repartition(n, "a", "da", "b", "db").mapInArrow(tidy(run), "u long, v long")


def simhash_groups(
    docs: DataFrame, shingle: int = SHINGLE, budget: int = ERRORS, leaf: int = LEAF
) -> DataFrame:
    """(doc_id, fp long, component_id) for every row: the smallest doc_id reachable by links."""
    rows = stage(fingerprints(docs, shingle))
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links_forest(distinct.select("fp"), budget, leaf))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    grouped = stage(grouped)
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(grouped.join(ids, "root").select("fp", "component_id"), "fp")


def without_near_copies(docs: DataFrame, budget: int = ERRORS) -> DataFrame:
    """Rows of `docs`, one per group: the one with the smallest doc_id, ids that are null last."""
    row = free_name(docs, "row")
    kept = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(row).alias("r"))
    groups = simhash_groups(kept.select(key.alias("doc_id"), "text"), budget=budget)
    first = groups.where("doc_id.r = component_id.r").select(F.col("doc_id.r").alias(row))
    return kept.join(first, row, "left_semi").drop(row)


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
