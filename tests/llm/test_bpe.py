"""Encoding against the public library, and round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowkit.llm import bpe

VOCABULARY = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def odd_texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "b", "aa", "the", " ", "  ", "\n", "\t", "é", "ß", "中", "😀", "'s", "'re", "1", "23", "!", "...", "<|", "|>",
            "<|endoftext|>", "̀", "\U0003d000", "࢏", "\0", "\x85", "�", "Ġ", "Ċ"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x2ff), rng.randint(0, 0xd7ff), rng.randint(0xe000, 0x10ffff)]))
                    for _ in range(30)) for _ in range(n)]
    return [*out, None, "", " ", "a" * 5001, " " * 3000, "ab" * 4001, "aaa bbb" * 99]


def test_ids_equal_the_library(library):
    v, texts = bpe.Vocabulary(VOCABULARY), odd_texts(3, 1500)
    ids = bpe.encode_block(v, texts)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert bpe.encode_block(v, texts) == ids, "words kept from the first call change nothing"
    assert [bpe.decode_ids(v, x) for x in ids] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert [bpe.decode_ids(v, x) for x in ids] == [t or "" for t in texts]


def test_full_word_memory_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    v = bpe.Vocabulary(VOCABULARY)
    texts = ["one two three four five one two", "six one seven two", "one six"] * 2
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, 6, 2):
        got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_block(v, texts[a:a + 2])]
        assert got == want[a:a + 2]
    assert len(v.known) == 3


def test_index_equals_merging_word_by_word():
    v, rng = bpe.Vocabulary(VOCABULARY), random.Random(5)
    rank = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(zip(v.left, v.right, v.made))}
    words = ["".join(rng.choice("aabelnrst") for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["a" * 41]

    def plain(word):
        ids = [v.letter_id[c] for c in word]
        while True:
            best = min(((*rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank), key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                return ids
            ids[best[2]:best[2] + 2] = [best[1]]

    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_pieces(v, words)] == [plain(w) for w in words]


def test_decoding_odd_ids():
    v = bpe.Vocabulary(VOCABULARY)
    broken = v.letter_id[bpe.byte_letters()[0xE9]]
    raw = np.array([broken, 10 ** 6, v.special["<|endoftext|>"]], "<u4").tobytes()
    assert bpe.decode_ids(v, raw) == "�<|endoftext|>"


def test_tables(spark, odd, nothing, library):
    rows = [tuple(r) for r in bpe.digests(odd).collect()]
    texts = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]
    want = []
    for i, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert bpe.digests(nothing).collect() == []
    assert sorted(map(repr, bpe.decode(bpe.encode(odd)).collect())) == sorted(map(repr, bpe.round_trip(odd).collect()))
    back = bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids binary")).first()
    assert back["text"] == ""


def test_blocks_of_texts(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 5)
    texts = ["ab", "cde", "f", None, "ghijklmn", "", "op"]
    blocks = [x.to_pylist() for x in bpe._text_blocks(pa.array(texts))]
    assert [t for block in blocks for t in block] == texts
    assert len(blocks) > 2 and all(len(block) == 1 or sum(len(t or "") for t in block) <= 5 for block in blocks)


def test_no_shuffle(odd):
    assert "Exchange" not in bpe.digests(odd)._jdf.queryExecution().executedPlan().toString()
