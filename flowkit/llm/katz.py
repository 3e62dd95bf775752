"""Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

Texts are cut into blocks of bounded size. A block sends its distinct words and word pairs, with
their training counts, as compressed arrays to the tables of n-gram counts, which are partitioned
by hash ranges; each range merges what all blocks sent and answers every block in the order in
which it asked. Contexts with very many pairs are spread over several ranges, and only their few
sums are broadcast. A block then evaluates its tokens: a pair seen in training has its discounted
share; another one backs off to the context's weight times the word's probability; all words not
seen in training share one unknown outcome, as in the base. Every conditional distribution over
the training words and the unknown one sums to one.

The counts grow with the corpus and stay in the tables; nothing is capped, pruned or sampled. Null
text counts as empty: its one token is the end. Words are lower-cased (A-Z) and split at white
space. Repeated rows count as often as they occur. A null id counts as the empty text for the fold.
Without training rows every token is unknown and has probability one. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import id_remainder, release_memory, tidy
from flowkit.staging import stage

FOLDS = 10
BLOCK_BYTES = 12 << 20
RANGE_BYTES = 8 << 20
LEAST_RANGES = 64
HOT_SHARE = 64
LARGEST = 5
SMOOTH = 0.1
START = 0
END = xxhash.xxh3_64_intdigest("\n")
_STATS = ["total", "kinds", "above", *(f"n{k}" for k in range(1, LARGEST + 2))]


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes."""
    v = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8")[:, 0]


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0..LARGEST+1 (1 where undefined), from counts of counts."""
    d = np.ones(LARGEST + 2)
    if n[1] <= 0:
        return d
    rest = (LARGEST + 1) * n[LARGEST + 1] / n[1]
    for r in range(1, LARGEST + 1):
        if n[r] > 0 and n[r + 1] > 0 and rest < 1:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
            if 0 < x < 1:
                d[r] = x
    return d


class Unigrams:
    """Discounted word probabilities; the unknown word has what is left, at least 1 / (N + 1)."""

    def __init__(self, stats: dict[str, int]) -> None:
        self.total, self.kinds = stats["total"], stats["kinds"]
        n = np.array([0, *(stats[f"n{k}"] for k in range(1, LARGEST + 2))], float)
        self.d = discounts(n)
        r = np.arange(1, LARGEST + 1)
        kept = (self.d[r] * r * n[r]).sum() + stats["above"]
        least = 1.0 / (self.total + 1)
        seen = min(kept / self.total, 1 - least) if self.total else 0.0
        self.unknown = 1.0 - seen
        self.scale = seen / kept if kept else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        mass = self.d[np.minimum(c, LARGEST + 1)] * c * self.scale
        return np.where(c > 0, mass, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.total + SMOOTH * (self.kinds + 1)))


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


def _count_stats(c: np.ndarray) -> list[int]:
    seen = c[c > 0]
    n = np.bincount(np.minimum(seen, LARGEST + 2), minlength=LARGEST + 3)
    return [int(seen.sum()), len(seen), int(seen[seen > LARGEST].sum()), *n[1:LARGEST + 2].tolist()]


def block_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys by falling frequency, each token's place among them, tokens per text with the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    index = flat.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    if "" in names:
        keep = index != names.index("")
        index, text = index[keep], text[keep]
    length = np.bincount(text, minlength=len(texts)) + 1
    out = np.full(int(length.sum()), len(keys), np.int64)
    ends = np.cumsum(length) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = index
    keys = np.append(keys, np.uint64(END))
    often = np.bincount(out, minlength=len(keys))
    order = np.argsort(-often, kind="stable")
    order = order[often[order] > 0]
    place = np.zeros(len(keys), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], place[out], length


class Block:
    """Tokens of a block with the global ids and training counts of its words."""

    def __init__(self, row: dict, answers: list[dict], ranges: int, hot: int) -> None:
        self.keys = np.frombuffer(row["keys"], np.uint64)
        self.at, self.length = unpack(row["at"]), unpack(row["length"])
        self.held = np.array(row["held"], bool)
        order = np.lexsort((self.keys, _range_of(self.keys, ranges)))
        parts = sorted(answers, key=lambda a: a["r"])
        self.ids, self.count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        self.ids[order] = np.concatenate([unpack(a["x"]) for a in parts])
        self.count[order] = np.concatenate([unpack(a["y"]) for a in parts])
        self.ranges, self.hot = ranges, hot

    def pairs(self, documents: int) -> None:
        """Distinct pairs, ordered by range, context and word, and each token's pair."""
        first = np.cumsum(self.length) - self.length
        n = len(self.keys)
        before = np.concatenate(([n], self.at[:-1]))
        before[first] = n
        kinds, self.of_token, = np.unique(before * (n + 1) + self.at, return_inverse=True)
        train = np.repeat(~self.held, self.length)
        times = np.bincount(self.of_token, train, len(kinds)).astype(np.int64)
        h, w = kinds // (n + 1), kinds % (n + 1)
        ids, count = np.append(self.ids, START), np.append(self.count, documents)
        spread = np.where(count[h] > self.hot, ids[w] % (count[h] // self.hot + 1), 0)
        r = _range_of(ids[h] + spread * 1_000_003, self.ranges)
        order = np.lexsort((ids[w], ids[h], r))
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        self.of_token = back[self.of_token].astype(np.int32)
        self.r, self.h, self.w = r[order], ids[h][order], ids[w][order]
        self.ch, self.cw, self.times = count[h][order], count[w][order], times[order]


def _contexts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First pair and number of pairs of each run of equal contexts."""
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(h)))


def _by_context(c: np.ndarray, cw: np.ndarray, first: np.ndarray, unigrams: Unigrams):
    """Per run of pairs of a context: pairs seen 1..LARGEST times, tokens above, seen words' mass."""
    def add(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first) if len(first) else x[:0]

    small = [add((c == k).astype(np.int64)) for k in range(1, LARGEST + 1)]
    return small, add(np.where(c > LARGEST, c, 0)), add(np.where(c > 0, unigrams.p(cw), 0.0))


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size, documents = docs.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)),
        F.coalesce(F.sum((id_remainder(F.col("doc_id"), FOLDS) != 0).cast("long")), F.lit(0))).first()
    ranges = max(LEAST_RANGES, ceil(size / RANGE_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names = ["block", "r", "ids", "held", "at", "length", "keys", "times"]
        for batch in batches:
            bytes_ = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                done = bytes_[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(bytes_, done + block_bytes, side="right")))
                few = batch.slice(a, b - a)
                keys, at, length = block_words(few.column(2))
                train = np.repeat(~few.column(1).to_numpy(zero_copy_only=False).astype(bool), length)
                times = np.bincount(at, train, len(keys)).astype(np.int64)
                yield pa.record_batch([
                    pa.array([block], pa.int64()), pa.array([-1], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, few.num_rows], pa.int32()), pa.concat_arrays([few.column(0)])),
                    pa.ListArray.from_arrays(pa.array([0, few.num_rows], pa.int32()), pa.concat_arrays([few.column(1)])),
                    *(pa.array([x], pa.binary()) for x in (pack(at), pack(length), keys.tobytes(), None))], names)
                r = _range_of(keys, ranges)
                order = np.lexsort((keys, r))
                cut = np.searchsorted(r[order], np.arange(ranges + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1])
                parts = [order[cut[k]:cut[k + 1]] for k in some]
                none = pa.nulls(len(some), pa.binary())
                yield pa.record_batch([
                    pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)),
                    pa.nulls(len(some), pa.list_(few.column(0).type)), pa.nulls(len(some), pa.list_(pa.bool_())),
                    none, none, pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                    pa.array([pack(times[p]) for p in parts], pa.binary())], names)
                block, a = block + 1, b

    read_rows = stage(docs.select(
        "doc_id", (id_remainder(F.col("doc_id"), FOLDS) == 0).alias("held"), "text").mapInArrow(
        tidy(read), f"block long, r int, ids array<{kind}>, held array<boolean>, at binary, length binary, "
              "keys binary, times binary"))
    blocks = read_rows.where("r < 0").select("block", "ids", "held", "at", "length", "keys")

    def merge_words(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [np.frombuffer(x["keys"], np.uint64) for x in rows]
        known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(inverse, np.concatenate([unpack(x["times"]) for x in rows]), len(known)).astype(np.int64)
        at = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        r = rows[0]["r"]
        stats = [None] * len(rows) + [_count_stats(times)]
        return pa.table({
            "block": pa.array([x["block"] for x in rows] + [-1], pa.int64()),
            "r": pa.array([r] * (len(rows) + 1), pa.int32()),
            "x": pa.array([pack(a * ranges + r + 1) for a in at] + [None], pa.binary()),
            "y": pa.array([pack(times[a]) for a in at] + [None], pa.binary()),
            "z": pa.nulls(len(rows) + 1, pa.binary()),
            "stats": pa.array(stats, pa.list_(pa.int64()))})

    answer = "block long, r int, x binary, y binary, z binary, stats array<long>"
    words = stage(read_rows.where("r >= 0").select("block", "r", "keys", "times").groupBy("r").applyInArrow(
        merge_words, answer))

    def totals(df: DataFrame) -> dict[str, int]:
        sums = [F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)).alias(n) for k, n in enumerate(_STATS)]
        return df.where("stats is not null").agg(*sums).first().asDict()

    unigrams = Unigrams(totals(words))
    hot = max(1, unigrams.total // hot_share)

    def send_pairs(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = {x: [] for x in ("block", "r", "hs", "hn", "hot", "ws", "times", "cw")}
        for row in block.to_pylist():
            b = Block(row, answers.to_pylist(), ranges, hot)
            b.pairs(documents)
            cut = np.searchsorted(b.r, np.arange(ranges + 1))
            for r in np.flatnonzero(cut[1:] > cut[:-1]):
                s = slice(cut[r], cut[r + 1])
                first, n = _contexts(b.h[s])
                for name, value in zip(out, (
                    row["block"], int(r), pack(b.h[s][first]), pack(n), pack(b.ch[s][first] > hot),
                    pack(b.w[s]), pack(b.times[s]), pack(b.cw[s]))):
                    out[name].append(value)
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
        release_memory()
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types)})

    to_blocks = words.where("block >= 0")
    sent = blocks.groupBy("block").cogroup(to_blocks.groupBy("block")).applyInArrow(
        send_pairs, "block long, r int, hs binary, hn binary, hot binary, ws binary, times binary, cw binary")

    def merge_pairs(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        hs = [np.repeat(unpack(x["hs"]), unpack(x["hn"])) for x in rows]
        h, w, times, cw = np.concatenate(hs), *(
            np.concatenate([unpack(x[c]) for x in rows]) for c in ("ws", "times", "cw"))
        order = np.lexsort((w, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])))
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        one = order[new]
        c = np.bincount(of, times).astype(np.int64)
        first, _ = _contexts(h[one])
        small, above, seen = _by_context(c, cw[one], first, unigrams)
        context = h[one][first]
        hot_h = np.unique(np.concatenate([unpack(x["hs"])[unpack(x["hot"]) > 0] for x in rows]))
        x, y, z = [], [], []
        at = 0
        for row, own in zip(rows, hs):
            asked = of[at:at + len(own)]
            at += len(own)
            k = np.searchsorted(context, own[_contexts(own)[0]])
            x.append(pack(c[asked]))
            y.append(pack(np.concatenate([s[k] for s in (*small, above)])))
            z.append(seen[k].tobytes())
        release_memory()
        k = np.searchsorted(context, hot_h)
        x.append(pack(hot_h))
        y.append(pack(np.concatenate([s[k] for s in (*small, above)])))
        z.append(seen[k].tobytes())
        return pa.table({
            "block": pa.array([row["block"] for row in rows] + [-1], pa.int64()),
            "r": pa.array([rows[0]["r"]] * len(x), pa.int32()),
            "x": pa.array(x, pa.binary()), "y": pa.array(y, pa.binary()), "z": pa.array(z, pa.binary()),
            "stats": pa.array([None] * len(rows) + [_count_stats(c)], pa.list_(pa.int64()))})

    merged = stage(sent.groupBy("r").applyInArrow(merge_pairs, answer))
    n = totals(merged)
    d = discounts(np.array([0, *(n[f"n{k}"] for k in range(1, LARGEST + 2))], float))
    wide = _hot_contexts(merged)
    bound = docs.sparkSession.sparkContext.broadcast(wide)

    def evaluate(block: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in block.to_pylist():
            rows = answers.to_pylist()
            b = Block(row, [a for a in rows if not a["pair"]], ranges, hot)
            b.pairs(documents)
            parts = sorted((a for a in rows if a["pair"]), key=lambda a: a["r"])
            c = np.concatenate([unpack(a["x"]) for a in parts])
            first, size_ = _contexts(b.h + (b.r << 40))
            sums = np.concatenate([unpack(a["y"]).reshape(LARGEST + 1, -1) for a in parts], axis=1)
            seen = np.concatenate([np.frombuffer(a["z"]) for a in parts])
            for k in np.flatnonzero(b.ch[first] > hot):
                sums[:, k], seen[k] = bound.value[int(b.h[first[k]])]
            ch = b.ch[first]
            r = np.arange(1, LARGEST + 1)
            kept = ((d[r] * r)[:, None] * sums[:-1]).sum(0) + sums[-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.minimum(kept / ch, 1 - 1 / (ch + 1.0))
                scale = np.where(kept > 0, share / kept, 0.0)
                backoff = np.where(kept > 0, (1 - share) / (1 - seen), 1.0)
            scale, backoff = np.repeat(scale, size_), np.repeat(backoff, size_)
            p = np.where(c > 0, d[np.minimum(c, LARGEST + 1)] * c * scale, backoff * unigrams.p(b.cw))
            begin = np.cumsum(b.length) - b.length
            known = b.count[b.at]
            table = {
                "doc_id": block.column("ids").combine_chunks().flatten() if block.num_rows == 1 else pa.array(row["ids"]),
                "held_out": pa.array(b.held), "n_tokens": b.length,
                "n_known": np.add.reduceat((known > 0).astype(np.int64), begin),
                "train_tokens": np.full(len(begin), unigrams.total),
                "base_score": np.add.reduceat(unigrams.base(known), begin),
                "score": np.add.reduceat(np.log10(p)[b.of_token], begin)}
            tables.append(pa.table(table))
            del b
            release_memory()
        return pa.concat_tables(tables)

    both = to_blocks.select("block", "r", "x", "y", "z", F.lit(False).alias("pair")).union(
        merged.where("block >= 0").select("block", "r", "x", "y", "z", F.lit(True).alias("pair")))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        evaluate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                  "base_score double, score double")


def _hot_contexts(merged: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """Sums of the contexts that lie in several ranges.

    Such a context holds over 1 / HOT_SHARE of the training tokens (or is the start of a text), so
    there are at most HOT_SHARE + 1 of them.
    """
    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = unpack(row["x"])
                sums = unpack(row["y"]).reshape(LARGEST + 1, -1)
                yield pa.record_batch(
                    [pa.array(h), *(pa.array(s) for s in sums), pa.array(np.frombuffer(row["z"]))],
                    ["h", *(f"s{k}" for k in range(LARGEST + 1)), "seen"])

    names = [f"s{k}" for k in range(LARGEST + 1)]
    rows = merged.where("block < 0").select("x", "y", "z").mapInArrow(
        tidy(open_), "h long, " + ", ".join(f"{s} long" for s in names) + ", seen double")
    got = rows.groupBy("h").agg(*[F.sum(s).alias(s) for s in (*names, "seen")]).collect()
    return {r["h"]: (np.array([r[s] for s in names]), r["seen"]) for r in got}
