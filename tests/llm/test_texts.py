"""SimHash, suffix arrays, toxicity, Katz: against brute force, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from flowkit.llm import katz, simhash, suffixes, toxicity
from flowkit.llm.common import LOWER, components, local_roots

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- helpers -----------------------------------------------------------------------------------

@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_local_roots(links):
    i, j = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    root = local_roots(21, i, j)
    want = list(range(21))
    for _ in range(21):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert root.tolist() == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- SimHash -----------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = (text or "").encode().translate(LOWER).split()
    grams = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    i, j = zip(*[(a, b) for a in range(len(fps)) for b in range(len(fps))
                 if (fps[a] ^ fps[b]).bit_count() <= 2])
    return local_roots(len(fps), np.array(i), np.array(j))


@pytest.mark.parametrize("leaf", [4096, 16])
def test_simhash_groups(docs, leaf):
    rows = sorted(texts_of(docs))
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_groups(fps)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs, leaf=leaf).collect()}
    assert got == {rows[k][0]: (fps[k], rows[root[k]][0]) for k in range(len(rows))}


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.lists(st.integers(0, 2**64 - 1), max_size=12),
       st.integers(0, 63))
@settings(max_examples=80, deadline=None)
def test_trie_links(seeds, others, bit):
    near = {x ^ (1 << bit) for x in seeds} | {x ^ 3 for x in seeds} | set(seeds) | set(others)
    a = np.array(sorted(near), np.uint64)
    i, j = simhash.trie_links(a, a, 0, 0, True)
    want = {(x, y) for x in range(len(a)) for y in range(x + 1, len(a)) if (int(a[x]) ^ int(a[y])).bit_count() <= 2}
    assert {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())} == want


def test_simhash_odd(odd, nothing):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_groups(odd).collect()]
    assert len(got) == 9
    assert {c for d, f, c in got if f == 0} == {2}
    assert [c for d, _, c in got if d is None] == [1]
    kept = simhash.without_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7]
    assert simhash.simhash_groups(nothing).count() == 0
    assert simhash.without_near_copies(nothing).count() == 0


# ---- suffix arrays -----------------------------------------------------------------------------

def brute_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[k:k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]) if len(r) else b""
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 1])
def test_removed_bytes(docs, hot):
    rows = texts_of(docs)
    want = collections.Counter((d, *x) for (d, _), x in zip(rows, brute_removed([t for _, t in rows], 400)))
    assert collections.Counter(map(tuple, suffixes.removed_bytes(docs, hot=hot).collect())) == want


@given(st.lists(st.text("ab", max_size=60).map(str.encode), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_repeated_starts(texts):
    segments = [t for t in texts if len(t) >= 8]
    if segments:
        got = suffixes.repeated_starts(segments, 8)
        seen = collections.Counter(s[k:k + 8] for s in segments for k in range(len(s) - 7))
        assert [g.tolist() for g in got] == [[seen[s[k:k + 8]] > 1 for k in range(len(s) - 7)] for s in segments]


@given(st.lists(st.integers(1, 4), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_suffix_array(symbols):
    order = suffixes.suffix_array(np.array(symbols), 200)
    assert order.tolist() == sorted(range(len(symbols)), key=lambda k: symbols[k:])


def test_suffixes_odd(spark, odd, nothing):
    got = suffixes.removed_bytes(odd)
    rows = texts_of(odd)
    want = collections.Counter((d, *x) for (d, _), x in zip(rows, brute_removed([t for _, t in rows], 400)))
    assert collections.Counter(map(tuple, got.collect())) == want
    cut = suffixes.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == 9
    assert suffixes.removed_bytes(nothing).count() == 0 and suffixes.without_repeats(nothing).count() == 0
    twice = spark.createDataFrame([(1, "x" + "é" * 300 + "y"), (2, "z" + "é" * 300 + "q")], "doc_id long, text string")
    assert sorted(r.text for r in suffixes.without_repeats(twice).collect()) == ["xy", "zq"]


# ---- toxicity ----------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels.where("toxic is not null"), "doc_id").toPandas()
    held = got[got.held_out]
    assert got.held_out.equals(got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0))
    assert (held.predicted == held.toxic).mean() > 0.95
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 0.01 * len(held)
    positive, negative = held[held.toxic == 1].score, held[held.toxic == 0].score
    assert np.mean([(p > negative).mean() for p in positive]) > 0.97


def test_toxicity_odd(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    mixed = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (5, 1, 0), (7, None, 0), (None, 1, 1), (6, 1, None), (6, 1, 7)],
        "doc_id long, quality int, toxic int")
    for labels in (none, mixed):
        got = toxicity.score_toxicity(odd, labels).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert toxicity.reject_toxic(odd, labels).columns == odd.columns
        assert toxicity.score_toxicity(nothing, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.5}


# ---- Katz --------------------------------------------------------------------------------------

def brute_katz(rows):
    words = [[*(t or "").encode().translate(LOWER).split(), None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    one, two, context = (collections.Counter() for _ in range(3))
    for w, h in zip(words, held):
        if not h:
            one.update(w)
            two.update(zip(["<s>", *w], w))
            context.update(["<s>", *w[:-1]])
    total, kinds = sum(one.values()), len(one)
    of = collections.Counter(one.values())
    uni = katz.Unigrams({"total": total, "kinds": kinds, "above": sum(c for c in one.values() if c > 5)}
                        | {f"n{k}": of[k] for k in range(1, 7)})
    p1 = {w: float(uni.p(np.array([c]))[0]) for w, c in one.items()}
    of = collections.Counter(two.values())
    d = katz.discounts(np.array([0, *(of[k] for k in range(1, 7))], float))
    after = collections.defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c
    given_ = {}
    for h, seen in after.items():
        kept, n = sum(d[min(c, 6)] * c for c in seen.values()), context[h]
        share = min(kept / n, 1 - 1 / (n + 1))
        backoff = (1 - share) / (1 - sum(p1[w] for w in seen))
        given_[h] = share / kept, backoff
        unseen = sum(p for w, p in p1.items() if w not in seen) + uni.unknown
        assert share + backoff * unseen == pytest.approx(1)
    assert sum(p1.values()) + uni.unknown == pytest.approx(1)
    out = []
    for (doc, _), w, h in zip(rows, words, held):
        score = base = 0.0
        for x, y in zip(["<s>", *w], w):
            p = p1.get(y, uni.unknown)
            if x in given_:
                scale, backoff = given_[x]
                c = after[x].get(y, 0)
                p = d[min(c, 6)] * c * scale if c else backoff * p
            score += math.log10(p)
            base += math.log10((one.get(y, 0) + 0.1) / (total + 0.1 * (kinds + 1)))
        out.append((doc, h, len(w), sum(y in one for y in w), total, base, score))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (repr(r[0]), round(r[6], 6)))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1 << 15, "hot_share": 2000}])
def test_katz(docs, options):
    want, got = order(brute_katz(texts_of(docs))), order(map(tuple, katz.score_texts(docs, **options).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9) for r in want]
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_katz_odd(odd, nothing):
    want, got = order(brute_katz(texts_of(odd))), order(map(tuple, katz.score_texts(odd).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9, abs=1e-12) for r in want]
    assert katz.score_texts(nothing).count() == 0


def test_pack_round_trip():
    for v in ([], [0], [255, 256], [2**40, 1, 0]):
        assert katz.unpack(katz.pack(np.array(v, np.int64))).tolist() == v




def test_pipeline_cuts_passages_of_fifty_words(spark):
    """A repeated passage of 51 short words is shorter than the 400 bytes of op6."""
    passage = " ".join(f"w{k % 10}q{k:02d}" for k in range(51))
    assert 200 < len(passage) < 400
    own = [" ".join(f"{name}{k}" for k in range(60)) for name in ("a", "b", "c")]
    rows = [(0, f"{own[0]} {passage}"), (1, f"{passage} {own[1]}"), (2, own[2])]
    got = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[2] == own[2] and kept[0].strip() == own[0] and kept[1].strip() == own[1]
