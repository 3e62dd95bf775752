"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The links are exact, up to collisions of 64-bit shingle hashes. Equal sets are merged first. Under
any common order of the shingles, two sets of the wanted similarity share one of their first
n - ceil(0.8 n) + 1 (prefix filter). The order puts common shingles last, by counts in a hashed table
of fixed size, so that a common passage brings texts together only if it is most of them. Texts that
share such a shingle are candidates. They stay rows (key, row), sorted and streamed; no list of a key
is gathered, and a key that is frequent in a sample of the texts is spread over several tasks.

First the fingerprints of op4, over the same shingles, are linked by its trie, and every text meets the
one text it shares most leading keys with. Keys with equal lists of texts count once. Then rounds follow: in every key, a text names the most similar
one of another group, by parity sketches (one bit per bucket of hashes, odd or even). Sketches differ in at
most as many bits as the sets differ in elements, so a pair that they reject cannot be similar. What is
named is computed from whole texts, sent once per chunk of partners, in a stream, and joins groups. A round
names at most one partner per text and key, so a large group of copies never forms all its pairs. After the
last round all pairs that sketches leave between groups are computed; no filter loses a pair. A key in which
the filters leave no pair is read in one round only.

Null text counts as empty; texts without words are copies of each other. Fewer than five words form
one shingle. Equal rows are copies. Texts of any length are read whole; a sketch has about one bit
per shingle. An empty table gives no rows. All columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm import simhash
from flowkit.llm.common import components, free_name, tidy, words
from flowkit.staging import bounded, stage

SHINGLE = 5
# Similarity of at least 4/5: intersection of at least 4/9 of the summed sizes.
SIMILAR = (4, 5)
COUNTERS = 1 << 18
SLICE = 256
# Texts of the sample that finds frequent keys, and rows a key may have in one task. They decide where rows go, never results.
KEY_SAMPLE = 4096
KEY_ROWS = 1 << 18
# Texts of a key in a block, and partners that share one copy of a text.
BLOCK = 512
CHUNK = 256
# Rounds in which texts name one partner a key; pairs, and bytes of sketches, that a task holds at once.
ROUNDS = 2
PAIRS = 1 << 16
SKETCHED = 1 << 18
# Groups of rows that a task unpacks at once.
UNPACKED = 1024


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of all shingles."""
    w = words(text)
    if not w:
        return np.zeros(0, np.int64)
    grams = [b" ".join(w)] if len(w) <= shingle else map(b" ".join, zip(*(w[k:] for k in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
    return np.unique(h.view(np.int64))


def sketch(h: np.ndarray) -> bytes:
    """Parities of the number of hashes per bucket; buckets are the last bits, at least 64 and at least len(h)."""
    size = max(64, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount(h & (size - 1), minlength=size).astype(np.uint8) & 1).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference; the longer sketch is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(folded ^ y).sum())


def similar(shared: int, sizes: int) -> bool:
    """Whether sets with `shared` common elements and summed sizes `sizes` are near copies."""
    p, q = SIMILAR
    return shared * (p + q) >= p * sizes


def _profiles(texts: DataFrame) -> DataFrame:
    """(row, digest, n, sketch) per text, and (counter, texts) per task: one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            digests, sizes, sketches = [], [], []
            for t in batch.column(1):
                h = shingle_set(t.as_py())
                np.add.at(total, h & (COUNTERS - 1), 1)
                digests.append(xxhash.xxh128_digest(h.tobytes()))
                sizes.append(len(h))
                sketches.append(sketch(h))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.record_batch(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(sketches, pa.binary()), none, none], ["row", "digest", "n", "sketch", "counter", "texts"])
        at = np.flatnonzero(total)
        yield pa.record_batch(
            [pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int32()),
             pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(total[at])],
            ["row", "digest", "n", "sketch", "counter", "texts"])

    return texts.select("row", "text").mapInArrow(
        tidy(run), "row long, digest binary, n int, sketch binary, counter long, texts long")


def _counts(profiles: DataFrame) -> np.ndarray:
    """Texts per counter; a counter stands for all hashes with the same last bits."""
    got = profiles.where("counter is not null").groupBy("counter").agg(F.sum("texts").alias("texts")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got.column("counter").to_numpy()] = got.column("texts").to_numpy()
    return out


def _prefixes(texts: DataFrame, shared) -> DataFrame:
    """(row, n, keys): the first shingles of each set in the common order, one row a text."""
    p, q = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                sizes, keys = [], []
                for t in part.column(1):
                    h = shingle_set(t.as_py())
                    length = len(h) - (p * len(h) + q - 1) // q + 1 if len(h) else 0
                    sizes.append(len(h))
                    keys.append(h[np.lexsort((h, counts[h & (COUNTERS - 1)]))[:length]])
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.record_batch(
                    [part.column(0), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], ["row", "n", "keys"])

    return texts.select("row", "text").mapInArrow(tidy(run), "row long, n long, keys array<long>")


def _placed_keys(prefixes: DataFrame) -> DataFrame:
    """(key, row, place) of prefixes; place is n << 32 | position."""
    return prefixes.select("row", "n", F.posexplode("keys").alias("position", "key")).select(
        "key", "row", (F.shiftleft("n", 32) + F.col("position")).alias("place"))


def _frequent_keys(texts: DataFrame, n_texts: int, shared) -> DataFrame:
    """(hot, tasks): keys that a sample of the texts lets expect in more than KEY_ROWS texts."""
    kept = max(1, n_texts // KEY_SAMPLE)
    share = F.pmod(F.xxhash64("row", F.lit("keys")), F.lit(kept)) == 0
    seen = _placed_keys(_prefixes(texts.where(share), shared)).groupBy("key").count()
    tasks = F.ceil(F.col("count") * kept / F.lit(KEY_ROWS)).cast("int")
    return seen.where((F.col("count") > 8) & (F.col("count") * kept > KEY_ROWS)).select(
        F.col("key").alias("hot"), tasks.alias("tasks"))


def _shared_keys(prefixes: DataFrame) -> DataFrame:
    """(key, row, place, lead) of keys with more than one row; lead is the first row of the key in its task.

    `prefixes` has a further column salt. Rows of a salted key all stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "row", "place", "lead"]
        held = None  # the last row, as it is not known yet whether its key goes on
        for batch in batches:
            key, salt, row, place = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            lead = np.zeros(len(key), np.int64)
            if held is not None:
                key, salt, row, place, lead = (
                    np.concatenate((h, c)) for h, c in zip(held, (key, salt, row, place, lead)))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            first = row[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            # A held row knows its lead and whether it was alone.
            goes_on = held is not None
            if goes_on:
                own = np.cumsum(new) == 1
                first[own] = lead[0]
            alone = new.copy()
            alone[:-1] &= new[1:]
            if goes_on and first[0] != row[0]:
                alone[0] = False
            alone &= salt < 0
            use = ~alone
            use[-1] = False
            held = [c[-1:] for c in (key, salt, row, place, first)]
            yield pa.record_batch([pa.array(c[use]) for c in (key, row, place, first)], names)
        if held is not None:
            key, salt, row, place, lead = held
            if lead[0] != row[0] or salt[0] >= 0:
                yield pa.record_batch([pa.array(c) for c in (key, row, place, lead)], names)

    dealt = prefixes.select("key", "salt", "row", "place").repartition("key", "salt")
    return dealt.sortWithinPartitions("key", "salt", "row").mapInArrow(
        tidy(run), "key long, row long, place long, lead long")


def _distinct_lists(members: DataFrame) -> DataFrame:
    """The members of one key for each list of rows that several keys have in common.

    Equal lists hold the same pairs. Lists are told apart by their length and 128 bits of hashes.
    """
    lists = members.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64("row", F.lit("lists"))).alias("b"))
    keys = lists.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key")
    return members.join(keys, "key", "left_semi")


def _possible(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (u, v) that sizes and sketches do not rule out."""
    p, q = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = np.minimum(n, m) * q >= np.maximum(n, m) * p
            for k in np.flatnonzero(ok):
                apart = sketch_distance(batch.column(3)[k].as_py(), batch.column(5)[k].as_py())
                ok[k] = similar((int(n[k]) + int(m[k]) - apart) // 2, int(n[k]) + int(m[k]))
            yield pa.record_batch(batch.columns[:2], ["u", "v"]).filter(pa.array(ok))

    u = profiles.select(F.col("row").alias("u"), F.col("n").cast("long").alias("nu"), F.col("sketch").alias("su"))
    v = profiles.select(F.col("row").alias("v"), F.col("n").cast("long").alias("nv"), F.col("sketch").alias("sv"))
    return pairs.join(v, "v").join(u, "u").select("u", "v", "nu", "su", "nv", "sv").mapInArrow(
        tidy(run), "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have the wanted similarity, in a stream sorted by u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk, lead = None, None, None
        for batch in batches:
            us, vs = [], []
            for u, c, v, text in zip(*(batch.column(k) for k in range(4))):
                u, c, v = u.as_py(), c.as_py(), v.as_py()
                h = shingle_set(text.as_py())
                if v is None:
                    own, chunk, lead = u, c, h
                    continue
                assert (own, chunk) == (u, c)
                if similar(len(np.intersect1d(lead, h, assume_unique=True)), len(lead) + len(h)):
                    us.append(u)
                    vs.append(v)
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    chunks = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("chunks"))
    dealt = stage(pairs.join(chunks, "u").select(
        "u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("chunk")))
    text = texts.select(F.col("row").alias("of"), "text")
    none = F.lit(None).cast("long")
    wanted = dealt.select("u", "chunk", F.col("v").alias("v"), F.col("v").alias("of")).union(
        dealt.select("u", "chunk", none, "u").distinct())
    rows = text.join(wanted, "of").select("u", "chunk", "v", "text").repartition("u", "chunk")
    return rows.sortWithinPartitions("u", "chunk", F.col("v").asc_nulls_first()).mapInArrow(
        tidy(run), "u long, v long")


def _leading(members: DataFrame) -> DataFrame:
    """(u, v): for every text the earlier one that leads most of its keys."""
    pairs = members.where("lead <> row").groupBy("row", "lead").count()
    best = pairs.groupBy("row").agg(F.max(F.struct("count", (-F.col("lead")).alias("before"))).alias("b"))
    return best.select((-F.col("b.before")).alias("u"), F.col("row").alias("v"))


def _fingerprint_links(texts: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(u, v): texts with equal fingerprints, or such that op4's trie connects, as a forest; rows of `copies` stay out."""
    rows = simhash.fingerprints(texts.select(F.col("row").alias("doc_id"), "text"), SHINGLE)
    if copies is not None:
        rows = rows.join(copies.select(F.col("row").alias("doc_id")), "doc_id", "left_anti")
    rows = stage(rows)
    first = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    twins = rows.join(first, "fp").where("doc_id <> first").select(F.col("first").alias("u"), F.col("doc_id").alias("v"))
    links = simhash.links_forest(first.select("fp"))
    near = links.join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select(
        F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return twins.union(near)


def sketch_distances(sketches: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`sketch_distance` of many pairs of positions; the longer sketch of a pair is folded."""
    sketches = sketches.cast(pa.large_binary())
    data = np.frombuffer(sketches.buffers()[2], np.uint8) if len(sketches) else np.zeros(0, np.uint8)
    ends = np.frombuffer(sketches.buffers()[1], np.int64)[sketches.offset:][:len(sketches) + 1]
    start, size = ends[:-1], np.diff(ends)
    swap = size[a] < size[b]
    long_, short = np.where(swap, b, a), np.where(swap, a, b)
    out, kinds = np.zeros(len(a), np.int64), size[long_] << 32 | size[short]
    for kind in np.unique(kinds):
        at, many, few = np.flatnonzero(kinds == kind), int(kind >> 32), int(kind & 0xFFFFFFFF)
        step = max(1, SKETCHED // many)
        for c in range(0, len(at), step):
            k = at[c:c + step]
            x = data[start[long_[k], None] + np.arange(many)].reshape(len(k), many // few, few)
            y = data[start[short[k], None] + np.arange(few)]
            out[k] = np.bitwise_count((np.bitwise_xor.reduce(x, axis=1) ^ y).view(np.uint64)).sum(1, dtype=np.int64)
    return out


def _meetings(group: np.ndarray, block: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of the rows that meet, both ways: of one group, and of both its blocks where it has two."""
    size = np.bincount(group)[group]
    first = np.concatenate([[0], np.cumsum(np.bincount(group))])[group]
    ends = np.cumsum(size)
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(at, to), size[at:to])
        b = first[a] + np.arange(len(a)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to])
        ok = np.where(same[group[a]], a != b, block[a] != block[b])
        yield a[ok], b[ok]
        at = to


def _block_pairs(members: DataFrame, profiles: DataFrame, every_pair: bool) -> DataFrame:
    """(key, u, v): pairs u < v of one key and different roots that sizes, places and sketches allow.

    `members` has key, row, place, root. A key with many rows is cut into blocks, and pairs of blocks
    meet. A shingle at places i and j leaves at most 1 + min(n - i - 1, m - j - 1) common ones from
    there on, and min(i, j) before. Unless `every_pair` is asked for, a text names only the one that
    its sketch is nearest to. With `every_pair` a pair has one row, with any of its keys. A key without a
    row has no pair left, and none when more roots have become equal.
    """
    p, q = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, UNPACKED) for batch in batches for at in range(0, batch.num_rows, UNPACKED)):
            x, key = part.column(3).flatten(), part.column(0).to_numpy()
            group = np.repeat(np.arange(part.num_rows), part.column(3).value_lengths().to_numpy())
            row, place, root, block = (x.field(k).to_numpy() for k in range(4))
            sketches, same = x.field(4), part.column(1).to_numpy() == part.column(2).to_numpy()
            n, place = place >> 32, place & 0xFFFFFFFF
            for a, b in _meetings(group, block, same):
                ok = (root[a] != root[b]) & (np.minimum(n[a], n[b]) * q >= np.maximum(n[a], n[b]) * p)
                if every_pair:
                    ok &= row[a] < row[b]
                a, b = a[ok], b[ok]
                most = 1 + np.minimum(n[a] - place[a] - 1, n[b] - place[b] - 1) + np.minimum(place[a], place[b])
                ok = most * (p + q) >= p * (n[a] + n[b])
                a, b = a[ok], b[ok]
                apart = sketch_distances(sketches, a, b)
                ok = similar((n[a] + n[b] - apart) // 2, n[a] + n[b])
                a, b, apart = a[ok], b[ok], apart[ok]
                if not every_pair:
                    order = np.lexsort((row[b], apart / np.maximum(1, n[a] + n[b]), a))
                    order = order[np.diff(a[order], prepend=-1) != 0]
                    a, b = a[order], b[order]
                if len(a):
                    yield pa.record_batch(
                        [pa.array(key[group[a]]), pa.array(np.minimum(row[a], row[b])),
                         pa.array(np.maximum(row[a], row[b]))], ["key", "u", "v"])

    open_ = stage(members.groupBy("key").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"),
    ).where("a <> b").select("key", "blocks"))
    placed = members.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).join(
        profiles.select("row", "sketch"), "row")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = placed.withColumn("other", other).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.struct("row", "place", "root", "block", "sketch").alias("x"))
    return met.groupBy("key", "i", "j").agg(F.collect_list("x").alias("x")).select("key", "i", "j", "x").mapInArrow(
        tidy(run), "key long, u long, v long").dropDuplicates(["u", "v"] if every_pair else ["key", "u", "v"])


def near_copy_roots(texts: DataFrame) -> DataFrame:
    """(row, root) for (row, text): root is the same for the rows of a group of linked texts."""
    both = stage(_profiles(texts))
    every = both.where("row is not null").select("row", "digest", "n", "sketch")
    shared = texts.sparkSession.sparkContext.broadcast(_counts(both))
    reps = stage(every.groupBy("digest").agg(F.min("row").alias("rep")))
    # Joins that leave copies out take fingerprints and prefixes, not texts.
    copies = stage(every.select("row", "digest").join(reps, "digest").where("row <> rep").select("row"))
    hot, _ = bounded(_frequent_keys(texts.join(copies, "row", "left_anti"), reps.count(), shared))
    salt = F.coalesce(F.pmod(F.xxhash64("row"), F.col("tasks")), F.lit(-1)).cast("long")
    prefixes = _placed_keys(_prefixes(texts, shared).join(copies, "row", "left_anti"))
    members = stage(_shared_keys(
        prefixes.join(hot, F.col("key") == F.col("hot"), "left").withColumn("salt", salt)))
    tried = stage(_fingerprint_links(texts, copies).union(_leading(members)).distinct())
    edges = stage(_verified(_possible(tried, every), texts))
    members = stage(_distinct_lists(members))
    left = ROUNDS
    while left >= 0:
        roots = stage(components(edges))
        grouped = stage(members.select("key", "row", "place").join(
            roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")))
        met = stage(_block_pairs(grouped, every, left == 0))
        members = members.join(met.select("key"), "key", "left_semi")
        named = stage(met.select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"))
        if named.isEmpty():  # nothing new: all pairs come next, unless this were all
            left = min(left, 1)
        else:
            tried = tried.union(named)
            edges = edges.union(stage(_verified(named, texts)))
        left -= 1
    roots = components(edges)
    of_rep = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("root", "rep").alias("root"))
    return every.select("row", "digest").join(of_rep, "digest").select("row", "root")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Rows of `docs`, one per group: the one with the smallest doc_id, ids that are null last."""
    row = free_name(docs, "row")
    kept = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    roots = near_copy_roots(kept.select(F.col(row).alias("row"), "text"))
    ids = kept.select(F.col(row).alias("row"), F.struct(
        F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(row).alias("r")).alias("k"))
    first = roots.join(ids, "row").groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.r").alias(row))
    return kept.join(first, row, "left_semi").drop(row)
