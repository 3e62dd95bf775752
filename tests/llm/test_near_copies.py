"""The pipeline's near copies against exact Jaccard similarity of all pairs."""

from __future__ import annotations

import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa

from flowkit.llm import near_copies
from flowkit.llm.common import LOWER, local_roots


def brute_set(text):
    w = (text or "").encode().translate(LOWER).split()
    return {b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_roots(texts):
    sets = [brute_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
             if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    i, j = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    return local_roots(len(sets), i, j)


def edited_texts():
    """Families of one text with up to six words replaced, some around a common passage."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for family in range(25):
        base = [f"f{family}w{k}" for k in range(rng.choice([3, 60, 120, 250]))]
        base += passage if family % 3 == 0 else []
        for _ in range(5):
            w = list(base)
            for k in rng.sample(range(len(w)), min(len(w) // 2, rng.randint(0, 6))):
                w[k] = f"e{rng.random()}"
            texts.append(" ".join(w))
    return [*texts, "", None, " \t", "one two", "ONE two", "one"]


def test_stage_removes_what_exact_jaccard_links(spark):
    texts = edited_texts()
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    root = brute_roots(texts)
    assert 20 < len(set(root)) < len(texts) - 20
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.tolist()))


def test_near_copies_odd(odd, nothing):
    kept = near_copies.without_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7]
    assert near_copies.without_near_copies(nothing).count() == 0


def test_split_keys_give_the_same_groups(spark, monkeypatch):
    """Every key is spread over tasks, lists are cut into blocks, texts go out in chunks of two."""
    for name, value in (("KEY_ROWS", 4), ("BLOCK", 3), ("CHUNK", 2)):
        monkeypatch.setattr(near_copies, name, value)
    texts = edited_texts()
    base = [f"b{k}" for k in range(80)]
    rng = random.Random(8)
    for _ in range(40):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randint(0, 3)):
            w[k] = f"e{rng.random()}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5)
    got = {r.row: r.root for r in near_copies.near_copy_roots(rows).collect()}
    want = brute_roots(texts)
    groups = {}
    for row, root in got.items():
        groups.setdefault(root, set()).add(row)
    expected = {}
    for row, root in enumerate(want.tolist()):
        expected.setdefault(root, set()).add(row)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 64, 65, 900, 4000):
        pool = np.unique(rng.integers(-2**63, 2**63 - 1, n + n // 4 + 1))
        for _ in range(20):
            a, b = (np.sort(rng.permutation(pool)[:rng.integers(0, n + 1)]) for _ in range(2))
            apart = near_copies.sketch_distance(near_copies.sketch(a), near_copies.sketch(b))
            assert apart <= len(np.setxor1d(a, b))


def test_a_group_of_near_copies_forms_no_square_of_pairs(spark, monkeypatch):
    """120 texts around one base, about 0.7 to 0.9 alike: each names few partners, and the groups are those of all pairs."""
    rng = random.Random(3)
    base, texts = [f"b{k}" for k in range(100)], []
    for _ in range(120):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randint(1, 3)):
            w[k] = f"e{rng.random()}"
        texts.append(" ".join(w))
    computed = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, t: computed.append(pairs.count()) or verified(pairs, t))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r.row: r.root for r in near_copies.near_copy_roots(rows).collect()}
    want = brute_roots(texts).tolist()
    assert len(set(got.values())) == len(set(want)) == len(set(zip(got.values(), (want[k] for k in got))))
    assert sum(computed) < 8 * len(texts)
    # all of one key and still in groups of their own, as texts are that their first partner did not link
    sketches = [(k, bytearray(near_copies.sketch(near_copies.shingle_set(texts[0])))) for k in range(120)]
    profiles = spark.createDataFrame(sketches, "row long, sketch binary")
    members = spark.range(120).selectExpr("1L AS key", "id AS row", "shiftleft(96L, 32) AS place", "id AS root")
    pairs = near_copies._block_pairs(members, profiles, False)
    assert pairs.count() < 120 and near_copies._block_pairs(members, profiles, True).count() == 120 * 119 // 2


def test_the_stage_links_by_the_trie_of_fingerprints(spark):
    """Texts whose five-word fingerprints are at most two bits apart come from op4's operator."""
    base = [f"b{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base, "more"]), "other words here and now and then"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    bits = [near_copies.simhash.fingerprint(t, 5) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= 2
    assert [tuple(r) for r in near_copies._fingerprint_links(rows).collect()] == [(0, 1)]


def test_sketch_distances_of_many_pairs():
    rng = np.random.default_rng(6)
    sketches = [near_copies.sketch(np.unique(rng.integers(-2**63, 2**63 - 1, n))) for n in (0, 3, 64, 65, 130, 300, 5000)]
    a, b = (x.ravel() for x in np.indices((7, 7)))
    got = near_copies.sketch_distances(pa.array([b"x" * 8, *sketches], pa.binary()).slice(1), a, b)
    assert got.tolist() == [near_copies.sketch_distance(sketches[i], sketches[j]) for i, j in zip(a, b)]


def test_sketches_of_many_pairs_are_compared_in_small_parts():
    rng = np.random.default_rng(5)
    sketches = [rng.bytes(512) for _ in range(64)]
    a, b = rng.integers(0, 64, (2, 1 << 15))
    tracemalloc.start()
    try:
        got = near_copies.sketch_distances(pa.array(sketches, pa.binary()), a, b)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[:50].tolist() == [near_copies.sketch_distance(sketches[i], sketches[j]) for i, j in zip(a[:50], b[:50])]
    assert peak < 12 << 20


def test_later_rounds_read_only_keys_that_still_have_pairs(spark, monkeypatch):
    """Equal lists of rows count once, and a key whose pairs the filters all rule out is read in one round only."""
    rng = random.Random(9)
    texts = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(120)]
        texts += [" ".join([*base, *(f"e{rng.random()}" for _ in range(120))]) for _ in range(3)]
    texts += [" ".join([*texts[0].split()[:-2], f"e{rng.random()}"]) for _ in range(3)]
    read, lists = [], []
    block_pairs, distinct_lists = near_copies._block_pairs, near_copies._distinct_lists
    monkeypatch.setattr(near_copies, "_block_pairs", lambda m, p, e: read.append(m.count()) or block_pairs(m, p, e))
    monkeypatch.setattr(near_copies, "_distinct_lists", lambda m: lists.append(m.count()) or distinct_lists(m))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(2)
    got = {r.row: r.root for r in near_copies.near_copy_roots(rows).collect()}
    want = brute_roots(texts).tolist()
    assert len(set(want)) < len(texts)
    assert len(set(got.values())) == len(set(want)) == len(set(zip(got.values(), (want[k] for k in got))))
    assert len(read) > 1 and 0 < 2 * read[0] < lists[0] and 2 * max(read[1:]) < read[0]


def test_distinct_lists_keep_one_key_of_equal_ones(spark):
    rows = [(1, 5), (1, 6), (2, 6), (2, 5), (3, 5), (3, 6), (3, 7), (4, 6), (4, 7)]
    members = spark.createDataFrame(rows, "key long, row long").repartition(3)
    assert sorted({r.key for r in near_copies._distinct_lists(members).collect()}) == [1, 3, 4]
