"""Suffix-array de-duplication: bytes under any 400-byte string that starts at two places.

1. A minimum over hashes of 64-byte grams picks one anchor inside every 400-byte string; equal
   strings pick equal anchors at equal places. The starts that share an anchor form a context.
2. Contexts whose anchor occurs once are done: none of their strings repeats. Equal contexts repeat
   as a whole. What is left, one copy of each, goes to shards by anchor, so that equal strings meet.
3. A shard sorts its suffixes by Larsson-Sadakane refinement and takes Kasai's common prefixes; a
   start with a common prefix of 400 bytes with a neighbour repeats.
4. An anchor with very many different contexts spans several shards. Their strings are merged by
   128-bit digests: each part cuts its sorted digests at fixed splitters by binary search, and every
   range is merged by itself.

Null text is empty; texts below 400 bytes lose nothing by themselves. Every row counts as a place,
so repeated rows remove each other's bytes. Matches never cross texts. An empty table gives no rows.
Other columns are ignored by `removed_bytes` and passed on by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkit.llm.common import release_memory, tidy
from flowkit.staging import scratch, stage, stage_result

LENGTH = 400
GRAM = 64
CHUNK_BYTES = 1 << 18
SHARD_BYTES = 1 << 19
SLICE_ROWS = 500
LEAST_SHARDS = 64
HOT_CONTEXTS = 1024
HOT_STRINGS = 1 << 19
_TABLES = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _doubling(h: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of all 2**k-byte strings up to `upto` bytes."""
    out, size = {1: h}, 1
    while size < upto:
        h = h[:-size] * (_MIX + np.uint64(4 * size)) + h[size:]
        size *= 2
        out[size] = h
    return out


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text begins and ends."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), begin


def contexts(data: np.ndarray, begin: np.ndarray, length: int, gram: int):
    """(text, first start, last start, anchor hash) of all contexts of concatenated texts.

    Starts count from the beginning of `data`.
    """
    grams = _scramble(_doubling(_TABLES[0][data], gram)[gram])
    window = length - gram + 1
    best = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size < window:
        step = min(size, window - size)
        best = np.minimum(best[:-step], best[step:])
        size += step
    owner = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[:len(owner)]
    start = np.flatnonzero(np.arange(len(owner)) + length <= begin[text + 1])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    anchor, text = owner[start], text[start]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return text[first], start[first], start[last], grams[anchor[first]]


def _pieces(data: np.ndarray, begin: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `limit` bytes: number of the first text, bytes, borders."""
    at = 0
    while at < len(begin) - 1:
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + limit)) - 1)
        to = min(to, len(begin) - 1)
        yield at, data[begin[at]:begin[to]], begin[at:to + 1] - begin[at]
        at = to


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def find_contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts of all texts: text key (k1, k2), id, lo, hi, anchor hash fp, content hash (c1, c2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = _buffers(batch.column(1))
            for at, part, borders in _pieces(data, begin, CHUNK_BYTES):
                if len(part) < length:
                    continue
                text, lo, hi, fp = contexts(part, borders, length, gram)
                if not len(text):
                    continue
                raw = memoryview(part)
                ends = (hi + length).tolist()
                pair = [xxhash.xxh3_128_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), ends)]
                key = {t: xxhash.xxh3_128_intdigest(raw[borders[t]:borders[t + 1]]) for t in np.unique(text).tolist()}
                keys = [key[t] for t in text.tolist()]
                low = (1 << 64) - 1
                yield pa.record_batch([
                    _signed([k >> 64 for k in keys]), _signed([k & low for k in keys]),
                    batch.column(0).take(pa.array(text + at)),
                    (lo - borders[text]).astype(np.int32), (hi - borders[text]).astype(np.int32), _signed(fp),
                    _signed([k >> 64 for k in pair]), _signed([k & low for k in pair]),
                ], ["k1", "k2", "id", "lo", "hi", "fp", "c1", "c2"])

    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").mapInArrow(
        tidy(run), "k1 long, k2 long, id string, lo int, hi int, fp long, c1 long, c2 long")


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least (1 to 511; 0 ends a text).

    Larsson-Sadakane: sort by the first few symbols, then refine only groups that still tie,
    by the group of the suffix that many symbols further on, doubling the sorted depth.
    """
    n, known = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(known, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(known):
        key = key << 9 | padded[k:k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    group = np.full(n + 1, -1, np.int64)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while known < depth and len(tied):
        suffix = order[tied]
        key = group[suffix] * (n + 1) + group[np.minimum(suffix + known, n)] + 1
        sort = np.argsort(key, kind="stable")
        suffix, key = suffix[sort], key[sort]
        order[tied] = suffix
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group[suffix] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = tied[~(new & np.append(new[1:], True))]
        known *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray, limit: int) -> np.ndarray:
    """Kasai: for each start, the bytes (at most `limit`) it shares with the one before it in `order`.

    Starts lie in runs (first, count); all runs advance together. From one start to the next the
    common prefix shrinks by one byte at most, as long as the neighbour's successor is a start too
    and lies before (ties in the order of bounded depth may turn it round).
    """
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.full(len(data) + 1, len(data), np.int64)
    place[order] = np.arange(len(order))
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    eight = np.ascontiguousarray(eight).view("<u8")[:, 0]
    shared = np.zeros(len(data), np.int64)
    longest = np.argsort(-count, kind="stable")
    first, count = first[longest], count[longest]
    height = np.zeros(len(first), np.int64)
    for t in range(int(count.max(initial=0))):
        live = int(np.searchsorted(-count, -t, side="left"))
        p = first[:live] + t
        q = before[p]
        h = np.maximum(height[:live] - 1, 0)
        at = np.flatnonzero((q >= 0) & (h < limit))
        h[q < 0] = 0
        while len(at):
            go = (h[at] + 8 <= limit) & (eight[p[at] + h[at]] == eight[q[at] + h[at]])
            rest = at[~go]
            at = at[go]
            h[at] += 8
            while len(rest):
                ok = (h[rest] < limit) & (data[np.minimum(p[rest] + h[rest], len(data) - 1)]
                                          == data[np.minimum(q[rest] + h[rest], len(data) - 1)])
                rest = rest[ok]
                h[rest] += 1
            at = at[h[at] < limit]
        shared[p] = h
        height = np.where((q >= 0) & (place[np.maximum(q, 0) + 1] < place[p + 1]), h, 0)
    return shared


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its `len - length + 1` starts repeat anywhere among them."""
    sizes = np.array([len(s) for s in segments])
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    count = sizes - length + 1
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    symbols = data.astype(np.int16) + 1
    symbols[first + sizes] = 0
    order = suffix_array(symbols, length)
    run = np.searchsorted(first, order, side="right") - 1
    order = order[order - first[run] < count[run]]
    shared = common_prefixes(data, order, first, count, length) >= length
    repeats = shared.copy()
    repeats[order[:-1][shared[order[1:]]]] = True
    return [repeats[f:f + c] for f, c in zip(first, count)]


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


RUNS = "fp long, c1 long, c2 long, runs array<struct<a:int,b:int>>"
_RUNS_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _verdicts(fp, c1, c2, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"fp": fp, "c1": c1, "c2": c2, "runs": pa.array(map(_runs, flags), _RUNS_TYPE)})


def in_shards(segments: DataFrame, shards: int, length: int) -> DataFrame:
    """Repeated starts of contexts by one suffix array per shard."""

    def run(group: pa.Table) -> pa.Table:
        flags = repeated_starts(group.column("seg").to_pylist(), length)
        release_memory()
        return _verdicts(group.column("fp"), group.column("c1"), group.column("c2"), flags)

    shard = F.pmod(F.xxhash64("fp"), F.lit(shards))
    return segments.withColumn("shard", shard).groupBy("shard").applyInArrow(run, RUNS)


def _digests(data: np.ndarray, length: int) -> np.ndarray:
    """128-bit digests, as pairs of words, of all strings of `length` bytes."""
    out = []
    for table in _TABLES:
        by_size, at, total = _doubling(table[data], length // 2 + 1), 0, None
        n = len(data) - length + 1
        for size in sorted(by_size, reverse=True):
            while at + size <= length:
                part = by_size[size][at:at + n]
                total = part if total is None else total * np.uint64(0xD6E8FEB86659FD93) + part
                at += size
        out.append(_scramble(total))
    return np.stack(out)


def across_shards(segments: DataFrame, ranges: int, length: int) -> DataFrame:
    """Repeated starts of the contexts of hot anchors, merged across parts by digest ranges."""
    splitters = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "range", "high", "low", "n", "at", "who"]
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, HOT_CONTEXTS):
                few = batch.slice(a, HOT_CONTEXTS)
                got = [_digests(np.frombuffer(s, np.uint8), length) for s in few.column(3).to_pylist()]
                count = np.array([g.shape[1] for g in got], np.int32)
                both = np.concatenate(got, axis=1)
                order = np.lexsort((both[1], both[0]))
                high, low = both[0][order], both[1][order]
                border = np.concatenate(([0], np.searchsorted(high, splitters), [len(high)]))
                who = np.stack([few.column(c).to_numpy() for c in range(3)])
                yield pa.record_batch(
                    [pa.array([part]), pa.array([-1]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                     pa.array([count.tobytes()], pa.binary()), pa.nulls(1, pa.binary()),
                     pa.array([who.tobytes()], pa.binary())], names)
                for r, (x, y) in enumerate(zip(border, border[1:])):
                    if x == y:
                        continue
                    h, w = high[x:y], low[x:y]
                    new = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
                    kind = (np.cumsum(new) - 1).astype(np.int32)
                    times = np.bincount(kind).astype(np.int32)
                    at = np.stack([order[x:y].astype(np.int32), kind])
                    yield pa.record_batch(
                        [pa.array([part]), pa.array([r]), pa.array([h[new].tobytes()], pa.binary()),
                         pa.array([w[new].tobytes()], pa.binary()), pa.array([times.tobytes()], pa.binary()),
                         pa.array([at.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names)
                part += 1

    parts = stage(segments.select("fp", "c1", "c2", "seg").mapInArrow(
        tidy(cut), "part long, range long, high binary, low binary, n binary, at binary, who binary"))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        high, low = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("high", "low"))
        times = np.concatenate([np.frombuffer(r["n"], np.int32) for r in rows])
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        kind = np.cumsum(new) - 1
        often = np.zeros(len(h), bool)
        often[order] = (np.bincount(kind, times[order]) > 1)[kind]
        out, at = [], 0
        for r in rows:
            own = often[at:at + len(r["n"]) // 4]
            at += len(own)
            where, of = np.frombuffer(r["at"], np.int32).reshape(2, -1)
            out.append(where[own[of]].tobytes())
        return pa.table({"part": group.column("part"), "starts": pa.array(out, pa.binary())})

    found = parts.where("range >= 0").groupBy("range").applyInArrow(merge, "part long, starts binary")

    def close(who: pa.Table, starts: pa.Table) -> pa.Table:
        if not who.num_rows:
            return _verdicts(*[pa.array([], pa.int64())] * 3, [])
        count = np.frombuffer(who.column("n")[0].as_py(), np.int32)
        flags = np.zeros(int(count.sum()), bool)
        for s in starts.column("starts").to_pylist():
            flags[np.frombuffer(s, np.int32)] = True
        ids = np.frombuffer(who.column("who")[0].as_py(), np.int64).reshape(3, -1)
        return _verdicts(*ids, np.split(flags, np.cumsum(count)[:-1]))

    return parts.where("range < 0").groupBy("part").cogroup(found.groupBy("part")).applyInArrow(close, RUNS)


def _text_key(docs: DataFrame) -> DataFrame:
    """`docs` (id, text, ...) with the key of the text, as `find_contexts` computes it."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*columns, "k1", "k2"]
        for batch in batches:
            keys = [xxhash.xxh3_128_intdigest((t.as_py() or "").encode()) for t in batch.column(at)]
            yield pa.record_batch(
                [*batch.columns, _signed([k >> 64 for k in keys]), _signed([k & (1 << 64) - 1 for k in keys])],
                names)

    keys = [T.StructField(k, T.LongType()) for k in ("k1", "k2")]
    return docs.mapInArrow(tidy(run), T.StructType(docs.schema.fields + keys))


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                  hot: int = HOT_CONTEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per text with repeats: key (k1, k2) and the runs (a, b) of starts that occur elsewhere too."""
    with scratch(docs.sparkSession) as kept:
        return stage_result(_find_runs(docs, length, gram, hot, shard_bytes), kept)


def _find_runs(docs: DataFrame, length: int, gram: int, hot: int, shard_bytes: int) -> DataFrame:
    found = stage(find_contexts(docs, length, gram))
    twice = stage(found.groupBy("fp").count().where("count > 1").select("fp"))
    by_text = ["fp", "c1", "c2", "k1", "k2", "lo", "hi"]
    shared = stage(found.join(twice, "fp").groupBy(*by_text).agg(F.count("*").alias("n"), F.min("id").alias("id")))
    kinds = stage(shared.groupBy("fp", "c1", "c2").agg(
        F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "id", "lo", "hi")).alias("x")))
    classes = stage(kinds.groupBy("fp").agg(F.count("*").alias("m")).where("m > 1"))
    open_ = kinds.join(classes, "fp").select("fp", "c1", "c2", "m", "x.*")
    wanted = stage(open_.groupBy("k1", "k2", "id").agg(
        F.collect_list(F.struct("fp", "c1", "c2", "m", "lo", "hi")).alias("cs")))
    texts = _text_key(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(0)[k].as_py().encode()
                cs = batch.column(1)[k].as_py()
                seg = [raw[c["lo"]:c["hi"] + length] for c in cs]
                yield pa.record_batch(
                    [pa.array([c[x] for c in cs], pa.int64()) for x in ("fp", "c1", "c2", "m")]
                    + [pa.array(seg, pa.binary())], ["fp", "c1", "c2", "m", "seg"])

    segments = stage(texts.join(wanted, ["k1", "k2", "id"]).select("text", "cs").mapInArrow(
        tidy(extract), "fp long, c1 long, c2 long, m long, seg binary"))
    cold, warm = segments.where(F.col("m") <= hot), segments.where(F.col("m") > hot)
    size, strings = segments.agg(
        F.coalesce(F.sum(F.when(F.col("m") <= hot, F.length("seg"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("m") > hot, F.length("seg") - (length - 1))), F.lit(0))).first()
    verdicts = in_shards(cold, max(LEAST_SHARDS, -(-size // shard_bytes)), length)
    if strings:
        verdicts = verdicts.union(across_shards(warm, max(LEAST_SHARDS, -(-strings // HOT_STRINGS)), length))
    verdicts = stage(verdicts.where("size(runs) > 0"))
    whole = shared.join(kinds.where("n > 1").select("fp", "c1", "c2"), ["fp", "c1", "c2"]).select(
        "k1", "k2", F.col("lo").alias("a"), F.col("hi").alias("b"))
    part = shared.join(verdicts, ["fp", "c1", "c2"]).select("k1", "k2", "lo", F.explode("runs").alias("r")).select(
        "k1", "k2", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b")).alias("b"))
    return (whole.union(part).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("runs")))


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are decoded at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(a, SLICE_ROWS)


def _spans(n: int, runs: list[dict[str, int]] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] + length) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removed_bytes(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    runs = repeated_runs(docs, length, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_slices(batches):
            out = []
            for k in range(batch.num_rows):
                raw = (batch.column(1)[k].as_py() or "").encode()
                spans = _spans(len(raw), batch.column(2)[k].as_py(), length)
                out.append((len(raw), sum(b - a for a, b in spans), len(spans),
                            hashlib.sha256(_kept(raw, spans)).hexdigest()))
            n, gone, spans, sha = zip(*out) if out else ((),) * 4
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = _text_key(docs.select("doc_id", "text"))
    return keyed.join(runs, ["k1", "k2"], "left").select("doc_id", "text", "runs").mapInArrow(
        tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """`docs` with the repeated bytes cut from `text`; a character that is cut through goes too."""
    runs = repeated_runs(docs, length, **options)
    names = docs.columns
    at, last = [c.lower() for c in names].index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_slices(batches):
            texts = batch.column(at).to_pylist()
            for k, r in enumerate(batch.column(last).to_pylist()):
                if r:
                    raw = texts[k].encode()
                    texts[k] = _kept(raw, _spans(len(raw), r, length)).decode("utf-8", "ignore")
            columns = [batch.column(c) for c in range(last)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names)

    renamed = docs.toDF(*[f"c{k}" if k != at else "text" for k in range(last)])
    keyed = _text_key(renamed).join(runs, ["k1", "k2"], "left").drop("k1", "k2")
    return keyed.mapInArrow(tidy(run), docs.schema)
