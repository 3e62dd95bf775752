"""Lexical retrieval packing: neighbours found by BM25 fill the window of each seed document.

Documents are dealt at random to shards of bounded size, and each shard holds its own inverted
index over token ids. Document frequencies are counted over all documents and broadcast: their
number is bounded by the vocabulary. Within a shard a seed fills its window; the best unused
neighbours by BM25 fill what is left, best first. The last one is cut, and its rest is the seed of
the next window, so only the last window of a shard has padding.

Null text counts as empty: such a document is the single end id. Every row is a document of its
own, also if its id is null or repeated. Equal scores go to the earlier row of the shard. A text
of any length is cut into as many windows as it needs. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import release_memory, tidy
from flowkit.llm.tokens import default_vocabulary, encoder
from flowkit.staging import stage

WINDOW = 1024
SHARD_TOKENS = 1 << 20
VOCABULARY_SIZE = 1 << 16
QUERY_TERMS = 64
K1, B = 1.2, 0.75
END = 0


def tokenize(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(row, doc_id, ids binary with the end id, n), written once; `row` numbers the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([END], "<u2").tobytes()
        for batch in batches:
            ids = [encode(t.as_py()) + end for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())],
                ["doc_id", "ids", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids binary, n long")
    return stage(out.withColumn("row", F.monotonically_increasing_id()))


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """Documents that contain each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY_SIZE, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total[np.unique(np.frombuffer(ids.as_buffer(), "<u2"))] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["term", "n"])

    counts = (
        tokens.select("ids").mapInArrow(tidy(run), "term long, n long")
        .groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    )
    out = np.zeros(VOCABULARY_SIZE, np.int64)
    out[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return out


class Index:
    """BM25 postings of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.n, self.idf = len(docs), idf
        owner = np.repeat(np.arange(self.n), [len(d) for d in docs])
        keys = owner.astype(np.int64) << 16 | np.concatenate(docs)
        keys, tf = np.unique(keys, return_counts=True)
        doc, term = keys >> 16, keys & 0xFFFF
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, self.n)))
        # 16 bits of term, 21 of document (shards are bounded), 26 of count (BM25 is flat up there)
        by_term = np.sort(term << 47 | doc << 26 | np.minimum(tf, (1 << 26) - 1))
        term, self.docs, tf = by_term >> 47, by_term >> 26 & 0x1FFFFF, by_term & 0x3FFFFFF
        length = np.array([len(d) for d in docs])[self.docs]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        self.weights = weight.astype(np.float32)
        self.start = np.searchsorted(term, np.arange(VOCABULARY_SIZE + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents of the shard for the seed's most telling terms."""
        terms = self.terms[seed]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")[:QUERY_TERMS]]
        at = np.concatenate([np.arange(a, b) for a, b in zip(self.start[terms], self.start[terms + 1])])
        return np.bincount(self.docs[at], self.weights[at], self.n)


def fill_windows(docs: list[np.ndarray], index: Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of all pieces of a shard."""
    unused = np.ones(len(docs), bool)
    number, used, first = 0, 0, 0
    seed, score = -1, None
    while True:
        if used == 0 or score is None:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return
            doc = first
        else:
            doc = int(np.argmax(np.where(unused, score, -np.inf)))
            if not unused[doc]:
                return
        unused[doc] = False
        start, size = 0, len(docs[doc])
        if used == 0:
            seed, score = doc, None
        while start < size:
            part = min(size - start, window - used)
            yield doc, start, part, number, used
            start += part
            used += part
            if used == window:
                number, used = number + 1, 0
                seed, score = doc, None
        if used and score is None:
            score = index.scores(seed)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW,
         shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenize(docs, vocabulary or default_vocabulary())
    n_docs, n_tokens = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(tokens)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    mean_length = n_tokens / max(1, n_docs)
    shards = max(1, -(-n_tokens // shard_tokens))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        ids = [np.frombuffer(x.as_buffer(), "<u2") for x in group.column("ids")]
        index = Index(ids, shared.value, mean_length)
        pieces = list(fill_windows(ids, index, window))
        doc, start, length, number, offset = (np.array(c, np.int64) for c in zip(*pieces))
        crc = [zlib.crc32(ids[d][s:s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        shard = group.column("shard")[0].as_py()
        sizes = np.array([len(x) for x in ids], np.int64)
        del index
        release_memory()
        return pa.table({
            "doc_id": group.column("doc_id").take(pa.array(doc)), "start": start, "length": length,
            "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": sizes[doc],
            "sequence_id": (shard << 32) + number, "offset": offset})

    kind = docs.schema["doc_id"].dataType.simpleString()
    shard = F.pmod(F.xxhash64("row", F.lit(shards)), F.lit(shards))
    return tokens.withColumn("shard", shard).groupBy("shard").applyInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long")
