"""Templates of the length of whole license texts, against the SQL without sketches."""

from __future__ import annotations

import random

import duckdb

from flowkit.llm import licenses


def test_long_templates_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(700)]
    rows = [(f"long-{n}", " ".join(rng.choices(vocabulary, k=n))) for n in (60, 75, 300, 1_500)]
    texts = ["", "other words only in this text here", None]
    for _, body in rows:
        w = body.split()
        before = [f"x{k}" for k in range(rng.randint(0, 900))]
        edited = list(w)
        for k in range(0, len(w), 60):
            edited[k] = "changed"
        texts += [" ".join(before + w), " ".join(before + edited + before), " ".join(before + w[:len(w) // 2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(docs, rows).collect())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert got == sorted(con.execute(licenses.scan_sql(rows)).fetchall())
    assert len(got) == 8
    assert set(licenses.window_sizes(rows)) == {2, 8, 32, 128, 512, 2048, 8192}
    assert licenses.window_sizes(licenses.TEMPLATES) == licenses.WINDOWS
