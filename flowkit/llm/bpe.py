"""Byte-level BPE by a pair occurrence index, and back.

A block of texts (part of an Arrow batch of a partition) is cut into pre-tokens; those of words that the
worker has not met yet form one array of symbols. An index maps every pair with a merge rank to all
its positions in that array. Active ranks are applied in ascending order, each to all its positions
at once, and only the lists of the pairs next to a merged position change. A merged pair can only
form pairs of higher rank (checked when the vocabulary is read), so one ascending pass over the
active ranks gives the same ids as merging word by word.

A null text counts as empty and has no ids. A text of any length is encoded as a whole. Special
tokens of the vocabulary are cut out of the text first, as the file declares them. Repeated rows and
null ids are rows like any other; other columns are ignored; an empty table gives no rows. Decoding
skips null ids and ids that the vocabulary lacks, and replaces invalid UTF-8 by U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import tidy
from flowkit.llm.tokens import plain_spaces

BLOCK_CHARS = 4_000_000  # of texts that share an index; a longer text is a block of its own
KNOWN_WORDS = 400_000  # words whose ids a worker keeps; a speed-up without effect on results
LONGEST_KNOWN = 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class Vocabulary:
    """Merge table, byte table and pre-tokenizer of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("expected a byte-level vocabulary without prefix space and normalizer")
        self.split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        letters = byte_letters()
        self.letter_id = {c: ids[c] for c in letters}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        ranks = np.arange(len(pairs))
        born = np.full(max(ids.values()) + 1, -1)
        born[made[::-1]] = ranks[::-1]
        if len(set(made.tolist())) < len(made) or (np.maximum(born[left], born[right]) >= ranks).any():
            raise ValueError("merges must form each token once, after its parts")
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made.astype(np.int32)
        keys = left << 32 | right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take their surroundings are not supported")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

        byte_of = {c: b for b, c in enumerate(letters)}
        texts = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        texts |= {i: t.encode() for t, i in self.special.items()}
        raw = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(t) for t in raw])
        self.start = np.cumsum(self.size) - self.size
        self.known: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 without one."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)


def merge_all(v: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apply all merges inside words laid end to end; `first` marks where words begin.

    Returns the symbols left and, for each word, how many.
    """
    n = len(symbols)
    sym = np.append(symbols, np.int32(-1))  # the last entry stands for "no neighbour"
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    starts = np.flatnonzero(first)
    after[starts[1:] - 1], before[starts] = n, n
    if n:
        after[n - 1] = n
    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray, rank: np.ndarray) -> None:
        """Enter the positions under their ranks."""
        some = rank >= 0
        if not some.any():
            return
        at, rank = at[some], rank[some]
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            parts = zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts))
        else:
            parts = [(int(rank[0]), at)]
        for r, part in parts:
            if r in lists:
                lists[r].append(part)
            else:
                lists[r] = [part]
                heapq.heappush(active, r)

    at = np.flatnonzero(after[:n] < n)
    add(at, v.ranks(sym[at], sym[after[at]]))
    merged = np.zeros(n + 1, bool)
    while active:
        r = heapq.heappop(active)
        parts = lists.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        x, y = v.left[r], v.right[r]
        at = at[(sym[at] == x) & (sym[after[at]] == y)]
        if x == y and len(at) > 1:  # of overlapping pairs, the ones from the left
            at = np.sort(at)
            new_run = np.append(True, after[at[:-1]] != at[1:])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        right = after[gone]
        sym[at], sym[gone] = v.made[r], -1
        after[at] = right
        before[right] = at
        sym[n] = -1
        left = before[at]
        merged[at] = True
        lone = (left < n) & ~merged[left]  # else the pair is the right one of its left neighbour
        merged[at] = False
        has_right = right < n
        pair = np.concatenate([left[lone], at[has_right]])
        if len(pair):
            add(pair, v.ranks(sym[pair], sym[after[pair]]))
    left_over = sym[:n] >= 0
    word = np.cumsum(first)[left_over] - 1
    return sym[:n][left_over], np.bincount(word, minlength=len(starts))


def encode_pieces(v: Vocabulary, pieces: list[str]) -> list[bytes]:
    """Ids (little-endian, unsigned 32-bit) of different pre-tokens, all in one index."""
    if not pieces:
        return []
    letter = v.letter_id
    symbols = np.array([letter[c] for p in pieces for c in p], np.int32)
    first = np.zeros(len(symbols), bool)
    sizes = np.array([len(p) for p in pieces])
    first[np.cumsum(sizes) - sizes] = True
    ids, counts = merge_all(v, symbols, first)
    raw = ids.astype("<u4").tobytes()
    ends = (4 * np.cumsum(counts)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def encode_block(v: Vocabulary, texts: list[str | None]) -> list[bytes]:
    """Ids of each text.

    A single space between two other characters begins a pre-token, so texts whose white space is
    plain are put together from words with their leading space; the words that are new to the
    worker, and all other texts, are cut into pre-tokens here.
    """
    known, split = v.known, v.split
    jobs: list[list] = []  # per text: ids (bytes), pre-tokens, or (words, their ids or None)
    new_words: dict[str, None] = {}
    pieces: dict[str, None] = {}

    def cut(text: str) -> list[str]:
        own = [p for p, _ in split(text)]
        pieces.update(dict.fromkeys(own))
        return own

    for text in texts:
        parts: list = []
        for piece in (v.cut.split(text) if v.cut else [text]) if text else []:
            if not piece:
                continue
            if piece in v.special:
                parts.append(np.array([v.special[piece]], "<u4").tobytes())
            elif plain_spaces(piece):
                head, *rest = piece.split(" ")
                ids = list(map(known.get, rest))
                parts.append(cut(head))
                if None in ids:
                    new_words.update((w, None) for w, i in zip(rest, ids) if i is None)
                    parts.append((rest, ids))
                else:
                    parts.append(b"".join(ids))
            else:
                parts.append(cut(piece))
        jobs.append(parts)

    words: list[list[str]] = []
    if new_words:
        for p in cut(" " + " ".join(new_words)):
            if p[0] == "Ġ":
                words.append([])
            words[-1].append(p)
    ids_of = dict(zip(pieces, encode_pieces(v, list(pieces))))
    found = {w: b"".join(map(ids_of.__getitem__, own)) for w, own in zip(new_words, words)}

    out = []
    for parts in jobs:
        row = []
        for part in parts:
            if isinstance(part, bytes):
                row.append(part)
            elif isinstance(part, list):
                row += map(ids_of.__getitem__, part)
            else:
                row += [found[w] if i is None else i for w, i in zip(*part)]
        out.append(b"".join(row))
    for w, ids in found.items():
        if len(known) >= KNOWN_WORDS:
            break
        if len(w) < LONGEST_KNOWN:
            known[w] = ids
    return out


def decode_ids(v: Vocabulary, raw: bytes) -> str:
    """Text of ids: the bytes of all tokens, invalid UTF-8 replaced."""
    ids = np.frombuffer(raw, "<u4")
    ids = ids[ids < len(v.size)]
    size = v.size[ids]
    ends = np.cumsum(size)
    at = np.repeat(v.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    return v.bytes[at].tobytes().decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One per Python worker and file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _text_blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of up to BLOCK_CHARS bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_CHARS, side="right")))
        yield texts.slice(a, b - a)
        a = b


def _mapped(docs: DataFrame, vocabulary: str | None, with_text: bool) -> DataFrame:
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(path)
        for batch in batches:
            at = 0
            for texts in _text_blocks(batch.column(1)):
                ids = encode_block(v, texts.to_pylist())
                columns = [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary())]
                if with_text:
                    columns.append(pa.array([decode_ids(v, raw) for raw in ids], pa.string()))
                yield pa.record_batch(columns, ["doc_id", "ids", "text"][: len(columns)])
                at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), f"doc_id {kind}, ids binary" + ", text string" * with_text)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids binary): token ids of `text` as little-endian unsigned 32-bit integers."""
    return _mapped(docs, vocabulary, False)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text): `decode(encode(docs))` in one worker per task."""
    return _mapped(docs, vocabulary, True)


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text): adds the text that the ids stand for; special tokens stay in it."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(path)
        for batch in batches:
            texts = [decode_ids(v, raw or b"") for raw in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, ids binary, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, encoded and decoded again."""
    return round_trip(docs, vocabulary).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
