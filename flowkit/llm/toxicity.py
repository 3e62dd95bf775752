"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one or two words between, of the
whole lower-cased text. Per-coordinate rates and the L1 term leave a sparse weight vector of at
most 2**HASH_BITS entries, so the broadcast is bounded whatever the corpus. The fit reads at most
about FIT_ROWS labelled rows, chosen by a hash of the id (a documented bound); every row is scored.

Null text counts as empty and gets the bias as score. Ties do not occur: rows are independent.
Several labels of one id count as toxic if any of them is; labels other than 0 and 1, and labels
of a null id, are ignored. Repeated rows are scored alike. Without usable labels every score is 0.
An empty table gives no rows. Other columns are ignored or, in `reject_toxic`, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import id_remainder, tidy
from flowkit.staging import stage

HASH_BITS = 20
FIT_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
GAPS = (1, 2, 3)
FOLDS = 5
SLICE_ROWS = 1000


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and the borders of each text among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    full = np.array([bool(w) for w in names], bool)
    index = flat.indices.to_numpy()
    keep = full[index] if len(index) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[keep]
    borders = np.searchsorted(owner, np.arange(len(texts) + 1))
    return of_word[index[keep]] if len(index) else np.zeros(0, np.uint64), borders


def features(h: np.ndarray) -> np.ndarray:
    """Distinct buckets of words, pairs and skip-pairs, for the word hashes of one text."""
    parts = [h]
    for gap in GAPS:
        if len(h) > gap:
            parts.append(
                (h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap))
                * np.uint64(0xD6E8FEB86659FD93))
    x = (np.concatenate(parts) >> np.uint64(64 - HASH_BITS)).astype(np.uint32)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _slices(texts: pa.Array) -> Iterator[np.ndarray]:
    for a in range(0, len(texts), SLICE_ROWS):
        h, at = token_hashes(texts.slice(a, SLICE_ROWS))
        for k in range(len(at) - 1):
            yield features(h[at[k]:at[k + 1]])


class Ftrl:
    """State of FTRL-proximal: z and n per coordinate, the last coordinate is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << HASH_BITS) + 1)
        self.n = np.zeros((1 << HASH_BITS) + 1)

    def weights(self, x: np.ndarray) -> np.ndarray:
        z, bias = self.z[x], x == len(self.z) - 1
        l1 = np.where(bias, 0.0, L1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[x])) / ALPHA + L2)

    def learn(self, x: np.ndarray, label: int) -> None:
        x = np.append(x, len(self.z) - 1).astype(np.int64)
        w = self.weights(x)
        g = sigmoid(w.sum()) - label
        sigma = (np.sqrt(self.n[x] + g * g) - np.sqrt(self.n[x])) / ALPHA
        self.z[x] += g - sigma * w
        self.n[x] += g * g


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0))))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic) of the labelled rows outside the held-out fold, about `fit_rows` at most."""
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(id_remainder(F.col("doc_id"), FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n = known.count()
    part = min(1.0, fit_rows / max(1, n))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(spread < part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "doc_id")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the non-zero weights, and the bias."""
    spark = docs.sparkSession

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [f.tobytes() for f in _slices(batch.column(0))]
            yield pa.record_batch(
                [pa.array(x, pa.binary()), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.string())],
                ["x", "y", "id"])

    rows = stage(_sample(docs, labels, fit_rows).mapInArrow(tidy(extract), "x binary, y int, id string"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for batch in batches:
            for x, y, i in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = x.as_py()
                data.append((xxhash.xxh3_64_intdigest(i + "|" + str(len(raw))), raw, y))
        data.sort()
        model = Ftrl()
        for _ in range(EPOCHS):
            for _, raw, y in data:
                model.learn(np.frombuffer(raw, np.uint32), y)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        if not data:
            at = at[:0]
        yield pa.record_batch([pa.array(at), pa.array(w[at])], ["i", "w"])

    got = rows.coalesce(1).mapInArrow(tidy(learn), "i long, w double").toArrow()
    i, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    bias = float(w[i == 1 << HASH_BITS].sum())
    keep = i < 1 << HASH_BITS
    return i[keep], w[keep], bias


def _scorer(docs: DataFrame, labels: DataFrame, fit_rows: int):
    """A function from an Arrow column of texts to scores."""
    i, w, bias = fit(docs, labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast((i, w.astype(np.float64), bias))

    def score(texts: pa.Array) -> np.ndarray:
        at, values, offset = shared.value
        dense = np.zeros(1 << HASH_BITS)
        dense[at] = values
        sums = np.fromiter((dense[x].sum() for x in _slices(texts)), np.float64, len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(sums + offset, -40.0, 40.0)))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    score = _scorer(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(batch.column(2))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(
        "doc_id", (id_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text",
    ).mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of `docs` with a score below 0.5, all columns unchanged."""
    score = _scorer(docs, labels, fit_rows)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
