"""Packing, mixing, pages, vectors, licenses and the pipeline: round trips, SQL and brute force."""

from __future__ import annotations

import os
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.llm import catalog, licenses, mixing, packing, pages, vectors
from flowkit.llm.common import local_roots
from flowkit.llm.tokens import default_vocabulary, encoder

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from check_oracle import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_with_sql(spark, name):
    problem, _ = compare(spark, connect(SMALL), SMALL, catalog.QUERIES[name], catalog.SQL[name])
    assert problem == ""


def test_names():
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{k}" for k in range(1, 11)]


# ---- packing -----------------------------------------------------------------------------------

def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_ids_equal_the_public_tokenizer(docs):
    odd = ["a  b", "\n\nx \ty", " lead", "trail ", "it's we'll  x", "<|endoftext|> a", "1 2 345,6.7 $$ 　x",
           "é è\nB c\n", "a \nb", "x\n y", "\r\nq a\x0bb", "🙂 🙃 ok", "a b  c", "", None]
    texts = odd + [r.text for r in docs.limit(60).collect()]
    encode = encoder(default_vocabulary()).encode
    assert [np.frombuffer(encode(t), "<u2").tolist() for t in texts] == reference_ids(texts)


def check_pieces(rows, texts):
    ids = {}
    for (doc, text), x in zip(texts, reference_ids([t for _, t in texts])):
        ids.setdefault(doc, []).append([*x, 0])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[doc]))
        if len(ids[doc]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                part = np.array(ids[doc][0][at:at + p.length], "<u4")
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[doc][0]), zlib.crc32(part.tobytes()))
                at += p.length
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 1024 - at
    return padding / (1024 * len(by_seq))


@pytest.mark.parametrize("shard", [1 << 20, 1 << 14])
def test_packing(docs, shard):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_pieces(packing.pack(docs, shard_tokens=shard).collect(), texts) < 0.05


def test_packing_takes_the_nearest_unused():
    docs = [np.array(x, np.uint16) for x in ([7] * 4 + [1], [9] * 5, [7] * 5, [7, 9, 9, 9, 9])]
    pieces = list(packing.fill_windows(docs, packing.Index(docs, np.ones(1 << 16), 5.0), 12))
    assert [p[0] for p in pieces[:3]] == [0, 2, 3]


def test_packing_odd(odd, nothing):
    check_pieces(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(nothing).count() == 0


# ---- mixing ------------------------------------------------------------------------------------

def test_mix_meets_targets_and_repeats(docs):
    rows = mixing.taken_words(docs, shard_words=20_000).toPandas()
    again = mixing.taken_words(docs.repartition(7), shard_words=20_000).toPandas()
    key = ["doc_id", "size", "taken"]
    assert rows.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    assert (rows.taken <= 2 * rows["size"]).all()
    by = rows.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(
        got=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.got - by.target) <= 1 + by["size"] / 1000).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())


def test_splitting_tree_is_exact(docs):
    plan = mixing.source_plan(docs.select("source", mixing.word_count(F.col("text")).alias("size"))).cache()
    leaves = mixing.shard_quotas(plan, 3).toPandas()
    quota = {r.s: r.quota for r in plan.collect()}
    assert leaves.groupby("s").n.sum().to_dict() == {s: q for s, q in quota.items() if q}
    sizes = leaves.groupby("shard").n.sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    for _, g in leaves.sort_values("first").groupby("s"):
        assert (g["first"].to_numpy() == np.concatenate(([0], g.n.cumsum().to_numpy()[:-1]))).all()


def test_hypergeometric_moments(spark):
    u = "pmod(xxhash64(id), 1073741824L) / 1073741824D"
    got = spark.range(4000).select(F.expr(mixing.hypergeometric("60", "20", "30", u)).alias("x")).agg(
        F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
    assert got[0] == pytest.approx(10, abs=0.15)
    assert got[1] == pytest.approx(30 * (1 / 3) * (2 / 3) * 30 / 59, rel=0.1)
    edge = spark.range(1).select(*[F.expr(mixing.hypergeometric(*x, "0.5D")) for x in (
        ("0", "0", "0"), ("5", "5", "2"), ("5", "0", "2"), ("1", "1", "0"))]).first()
    assert tuple(edge) == (0, 2, 0, 0)


def test_mixed_rows(docs):
    mixed = mixing.mixed_rows(docs, shard_words=20_000)
    assert mixed.columns == docs.columns
    words = mixed.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == mixing.taken_words(docs, 20_000).agg(F.sum("taken")).first()[0]


def test_mixing_odd(odd, nothing):
    rows = mixing.taken_words(odd).collect()
    assert len(rows) == 9 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.taken_words(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0


# ---- pages -------------------------------------------------------------------------------------

PAGES = [
    ('<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><header><h1>Site</h1></header>'
     '<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div><article><h1>Title &amp; more</h1>'
     '<p>One  <b>two</b>\nthree.<p>Yes.</p><form><input>f</form><div class="cookie-notice">n</div></article>'
     '<section id="comments"><p>Nice!</p></section><footer>&copy; x</footer></body></html>',
     "Title & more\nOne two three.\nYes."),
    ('<body><div id="menu"><a href=x>Home</a></div><div class="content"><h2>Head</h2><p>' + "word " * 40
     + '</p><p>Short end.</p></div><aside>side</aside><div class="commentList"><p>c</p></div></body>',
     "Head\n" + " ".join(["word"] * 40) + "\nShort end."),
    (None, ""), ("", ""), ("plain", "plain"), ("<p", ""), ("a < b &lt;c&gt;", "a < b <c>"),
    ("<article><p>cut &amp; off <b>x", "cut & off x"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert pages.main_text(page) == text


def test_no_region_of_text_is_lost():
    text = "<p>" + "word " * 40 + "</p>"
    links = "<ul>" + "<li><a href=x>A link</a></li>" * 4 + "</ul>"
    want = " ".join(["word"] * 40)
    assert pages.main_text(f"<body><div>{text}</div>{links}<div>{text}</div></body>") == f"{want}\n{want}"
    article = (f"<article><header class='entry-header'><h1>Title</h1></header><p>By <math><mi>x</mi></math></p>{text}"
               f"<div class='related-work notice'>Kept</div>{links}<div class='ads'>Buy</div></article>")
    assert pages.main_text(article) == "\n".join(["Title", "By x", want, "Kept", *["A link"] * 4])


def test_pages_table(spark):
    rows = [(1, "u", PAGES[0][0]), (1, "u", PAGES[0][0]), (None, None, None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in pages.extract_pages(df).collect()))
    text = PAGES[0][1]
    assert got == [(0, "", 0), (1, text, len(text)), (1, text, len(text))]
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_deep_pages_take_linear_time():
    for page in ("<b>x</i>" * 20_000, "<div>x" * 20_000, '<a "' * 50_000, "<b>" * 20_000 + "</p>" * 20_000):
        pages.main_text(page)


# ---- vectors -----------------------------------------------------------------------------------

def vector_rows(seed, n, dims):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    base[n // 2:] = base[rng.integers(0, 5, n - n // 2)] + 0.05 * rng.normal(size=(n - n // 2, dims))
    base[-3:] = base[0]
    return [[float(x) for x in v] for v in np.float32(base)]


ODD_VECTORS = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = [(k, v, 0) for k, v in enumerate(vector_rows(3, 400, 8))]
    rows += [(500 + 20 * k, v, None) for k, v in enumerate(ODD_VECTORS)] + [(None, [1.0] * 8, 1), (40, [2.0] * 8, 1)]
    return spark.createDataFrame(rows, VECTORS)


def usable(rows):
    return [(i, np.pad(np.array(v, float), (0, 8 - len(v)))) for i, v, _ in rows
            if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]


@pytest.mark.parametrize("block", [2048, 37])
def test_top_k(embeddings, monkeypatch, block):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "STEP", 16)
    rows = usable(embeddings.collect())
    ints = [(i if i is not None else 1 << 63, np.floor(64 * v).astype(int).tolist()) for i, v in rows]
    want = []
    for k, (q, x) in enumerate(ints):
        if q % 20 == 0 and q < 1 << 63:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, (i, y) in enumerate(ints) if j != k)[:20]
            want += [(q, r + 1, i if i < 1 << 63 else None, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(repr, map(tuple, vectors.exact_top_k(embeddings).collect()))) == sorted(map(repr, want))


def test_top_k_with_large_numbers():
    v = np.array([[2**40, 1], [2**40, 2]], np.int64)
    assert vectors.dot_products(v, np.array([3, 2**20], np.int64)).tolist() == [3 * 2**40 + 2**20, 3 * 2**40 + 2**21]


def test_top_k_reads_few_pivots_of_a_block():
    """Reading all 64 cost more than the products they were to save."""
    class Table(list):
        read = 0

        def __getitem__(self, at):
            self.read += 1
            return super().__getitem__(at)

    rng = np.random.default_rng(4)
    for high in (2, 64):  # many ties, few ties
        v = rng.integers(0, high, (700, 64))
        ids, rows, norms = rng.integers(0, 500, 700), np.arange(700), (v.astype(float) ** 2).sum(1)
        to_pivots = np.sqrt(((v[:, None] - v[None, :64]) ** 2).sum(2))
        for q in range(0, 700, 100):
            for plain in (None, v.astype(float)):
                table = Table(np.ascontiguousarray(to_pivots.T))
                at, score = vectors.best_of_block(v[q], to_pivots[q], q, rows, ids, v, table, norms, 20, plain)
                want = sorted((-int(v[k] @ v[q]), ids[k]) for k in range(700) if k != q)[:20]
                assert list(zip(-score, ids[at])) == want and table.read <= 8


def test_near_duplicates(embeddings, monkeypatch):
    monkeypatch.setattr(vectors, "RESIDENTS", 50)
    monkeypatch.setattr(vectors, "VISITORS", 60)
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    data = embeddings.collect()
    rows = [(i, v) for i, v in usable(data) if np.linalg.norm(v) > 0]
    u = np.array([v / np.linalg.norm(v) for _, v in rows])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = local_roots(len(rows), *np.nonzero(near))
    ids = [i for i, _ in rows]
    comp = {r: min((ids[k] for k in np.flatnonzero(root == r) if ids[k] is not None), default=None) for r in set(root)}
    want = sorted((repr(ids[k]), int(near[k].sum()), repr(comp[root[k]])) for k in range(len(rows)))
    got = vectors.near_duplicates(embeddings).collect()
    assert len(got) == len(data)
    linked = {repr(i) for i, _ in rows}
    live = sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in got if repr(r.vec_id) in linked)
    found, exact = sum(x[1] for x in live), sum(x[1] for x in want)
    assert 0.9 * exact <= found <= exact and found >= 0.97 * exact
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if repr(r.vec_id) not in linked)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_cells_to_visit_hold_for_unseen_vectors():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4096 + 1024 + 600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.MultiIndex(x[:4096], x[4096:5120], 100, 0.9, 0.98)
    fresh = x[5120:]
    side = rng.normal(size=fresh.shape)
    side -= (side * fresh).sum(1, keepdims=True) * fresh
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    other = 0.9 * fresh + np.sqrt(1 - 0.81) * side
    met = np.zeros(len(fresh), bool)
    for p, q in ((fresh, other), (other, fresh)):
        met |= (index.nearest_cells(p, index.visits) == index.home(q)[:, None]).any(1)
    print("recall", met.mean(), "cells", index.visits)
    assert met.mean() >= 0.96


def test_vectors_empty(spark):
    none = spark.createDataFrame([], VECTORS)
    bad = spark.createDataFrame([(0, None, 1), (20, [0.0, 0.0], 1)], VECTORS)
    assert vectors.exact_top_k(none).count() == 0 and vectors.near_duplicates(none).count() == 0
    assert vectors.exact_top_k(bad).count() == 0
    assert sorted(map(tuple, vectors.near_duplicates(bad).collect())) == [(0, 0, 0, True), (20, 0, 20, True)]


# ---- licenses ----------------------------------------------------------------------------------

def test_every_template_is_found_at_any_place(spark):
    rows, want = [], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        for shift in (0, 1, 7, 33):
            doc = 100 * k + shift
            rows.append((doc, " ".join([f"a{i}" for i in range(shift)] + [text.upper()] + ["z"] * (shift % 5))))
            want.add((doc, name))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert want <= {(r.doc_id, r.template) for r in got}
    assert all(r.shared >= 0.8 * r.of_shingles for r in got)


def test_changed_template_and_odd(spark, odd, nothing):
    text = dict(licenses.TEMPLATES)["MIT-permission"]
    near = text.replace("charge", "cost")
    far = text.replace("of", "off").replace("the", "thee").replace("to", "too")
    df = spark.createDataFrame([(1, near), (2, far), (2, near), (2, near)], "doc_id long, text string")
    assert sorted((r.doc_id, r.template) for r in licenses.scan(df).collect()) == [(1, "MIT-permission")] + [
        (2, "MIT-permission")] * 2
    assert licenses.scan(odd).count() == 0 and licenses.scan(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.templates(spark, [("short", "a b c")])


# ---- pipeline ----------------------------------------------------------------------------------

def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows
        before = spark.createDataFrame(rows, docs.schema)
    rows = pipeline.run(spark, SMALL).collect()
    texts = [(r.doc_id, r.text) for r in before.collect()]
    assert check_pieces(rows, texts) < 0.05
