"""License scan: MinHash sketches of overlapping windows retrieve templates; containment verifies.

Templates are grouped by length. A group has its own window size W (in five-word shingles) and a
stride of W/2, so that every template of the group lies whole in some window of any text that
contains it. A window's sketch are its k smallest shingle hashes, each a band of one row; the index
holds all hashes of the templates, and a window meets a template if a band agrees. A window that
holds s of the template's shingles misses all of them with probability C(W-s, k) / C(W, k): zero for
the two small sizes (k > W - s), below 0.004 for the others, at the shortest template of the group
and a containment of 0.8. Templates longer than the largest size serves get further sizes, each four
times the one before, so that whole license texts can be searched. Candidates are then verified by exact containment of the template's
shingles, compared as text. All of it is DataFrame and SQL functions.

Texts are lower-cased (A-Z) and split at white space. Null and empty texts, and texts below five
words, match nothing. Texts of any length are read whole. Repeated rows each give their matches; of
windows with equal containment the first is reported. Templates below five words are refused; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.llm.common import WORD, bind, words
from flowkit.staging import stage

SHINGLE = 5
CONTAINED = 0.8
#: Size of windows in shingles -> bands. A size W serves templates of up to W // 2 + 1 shingles.
WINDOWS = {2: 2, 8: 6, 32: 20, 128: 40}
#: Bands of larger sizes: at a containment of 0.8 a tenth of such a window belongs to the template.
LONG_BANDS = 54

# Wording of public license notices.
TEMPLATES = [
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0-notice",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-redistribution",
     "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met:"),
    ("Apache-2.0-header",
     "you may not use this file except in compliance with the License. You may obtain a copy of "
     "the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-header",
     "This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation, either version "
     "3 of the License, or (at your option) any later version."),
    ("MIT-permission",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software"),
]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def window_sizes(rows: list[tuple[str, str]]) -> dict[int, int]:
    """Size of windows -> bands, up to a size that serves the longest of the templates."""
    longest = max((len(words(text)) - (SHINGLE - 1) for _, text in rows), default=0)
    sizes = dict(WINDOWS)
    while max(sizes) // 2 + 1 < longest:
        sizes[max(sizes) * 4] = LONG_BANDS
    return sizes


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))


def shingle_hashes(words: Column) -> Column:
    """Hash of every run of five words; none for fewer words."""
    at = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)))
    return F.coalesce(
        F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(SHINGLE)])),
        F.array().cast("array<bigint>"))


def shingle_texts(words: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def sketch(hashes: Column, bands: Column) -> Column:
    """The smallest distinct hashes of a window."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), F.lit(1), bands)


def templates(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """(template, size, window, shingles, band) with one row per band value."""
    rows = TEMPLATES if rows is None else rows
    short = [name for name, text in rows if len(text.split()) < SHINGLE]
    if short:
        raise ValueError(f"templates below {SHINGLE} words: {short}")
    base = spark.createDataFrame(rows, "template string, text string").select(
        "template", word_list(F.col("text")).alias("words"))
    sized = base.select(
        "template", shingle_texts(F.col("words")).alias("shingles"), shingle_hashes(F.col("words")).alias("h"))
    window = F.coalesce(*[F.when(F.size("h") <= w // 2 + 1, F.lit(w)) for w in sorted(window_sizes(rows))])
    return sized.withColumn("window", window).select("template", "window", "shingles", F.explode(F.array_distinct("h")).alias("band"))


def scan(docs: DataFrame, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, template, start_word, shared, of_shingles: per document and template it contains."""
    rows = TEMPLATES if rows is None else rows
    sizes = window_sizes(rows)
    known = stage(templates(docs.sparkSession, rows))
    shingles = {r["template"]: r["shingles"] for r in known.select("template", "shingles").distinct().collect()}
    used = sorted(r[0] for r in known.select("window").distinct().collect())
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def of_size(h: Column, w: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - 1, F.lit(max(1, w // 2))),
            lambda s: F.struct(
                F.lit(w).alias("window"), F.lit(sizes[w]).alias("bands"), s.alias("start"),
                F.slice(h, s + 1, w).alias("h")))

    def cut(h: Column) -> Column:
        return F.when(F.size(h) > 0, F.flatten(F.array(*[of_size(h, w) for w in used])))

    hashes = bind(word_list(F.col("text")), shingle_hashes)
    windows = base.select("doc_id", "text_key", F.explode(bind(hashes, cut)).alias("x"))
    bands = windows.select(
        "doc_id", "text_key", F.col("x.window").alias("window"), F.col("x.start").alias("start"),
        F.explode(sketch(F.col("x.h"), F.col("x.bands"))).alias("band"))
    wanted = stage(
        bands.join(F.broadcast(known.select("template", "window", "band")), ["window", "band"])
        .groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        .agg(F.collect_set(F.struct("template", "window", "start")).alias("cs")))
    same = (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    met = base.join(wanted.select("id", "key"), same, "left_semi")
    found = met.join(wanted, same)
    texts = F.create_map(*[x for t, s in shingles.items() for x in (F.lit(t), F.array(*map(F.lit, s)))])

    def verify(words: Column) -> Column:
        shared = F.transform("cs", lambda c: bind(texts[c["template"]], lambda known: F.struct(
            c["template"].alias("template"), c["start"].alias("start"), F.size(known).alias("of"),
            F.size(F.array_intersect(known, bind(
                F.slice(words, c["start"] + 1, c["window"] + (SHINGLE - 1)), shingle_texts))).alias("shared"))))
        return F.filter(shared, lambda c: c["shared"] >= CONTAINED * c["of"])

    def first_best(verified: Column) -> Column:
        names = F.array_distinct(F.transform(verified, lambda c: c["template"]))
        return F.transform(names, lambda t: F.array_max(F.transform(
            F.filter(verified, lambda c: c["template"] == t), lambda c: F.struct(
                c["shared"].alias("shared"), (-c["start"]).alias("before"), c["of"].alias("of"),
                t.alias("template")))))

    best = bind(bind(word_list(F.col("text")), verify), first_best)
    return found.select("doc_id", F.explode(best).alias("m")).select(
        "doc_id", "m.template", (-F.col("m.before")).cast("long").alias("start_word"),
        F.col("m.shared").cast("long").alias("shared"), F.col("m.of").cast("long").alias("of_shingles"))


def scan_sql(rows: list[tuple[str, str]] | None = None) -> str:
    """The same matches by exact containment of every window, without sketches."""
    rows = TEMPLATES if rows is None else rows
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in rows)
    lower = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
    split = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
    size = " ".join(f"WHEN n <= {w // 2 + 1} THEN {w}" for w in sorted(window_sizes(rows)))
    return f"""
WITH t0(template, text) AS (VALUES {quoted}),
t1 AS (SELECT template, {split.format(lower.format('text'))} AS w FROM t0),
t2 AS (SELECT template, len(w) - 4 AS n, unnest(range(1, len(w) - 3)) AS i, w FROM t1),
t3 AS (SELECT DISTINCT template, n, array_to_string(w[i:i + 4], ' ') AS shingle FROM t2),
t AS (SELECT *, CASE {size} END AS win, count(*) OVER (PARTITION BY template) AS of_ FROM t3),
d1 AS (SELECT row_number() OVER () AS r, doc_id, {split.format(lower.format("coalesce(text, '')"))} AS w
       FROM documents),
d2 AS (SELECT r, doc_id, len(w) - 4 AS n, unnest(range(1, len(w) - 3)) AS i, w FROM d1 WHERE len(w) > 4),
d AS (SELECT r, doc_id, n, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS shingle FROM d2),
m AS (SELECT d.*, t.template, t.win, t.of_, greatest(1, t.win // 2) AS stride FROM d JOIN t USING (shingle)),
s AS (SELECT *, unnest(range(greatest(0, p - win + 1 + (-(greatest(0, p - win + 1)) % stride + stride) % stride),
                              p + 1, stride)) AS start FROM m),
g AS (SELECT r, doc_id, template, start, of_, count(DISTINCT shingle) AS shared FROM s
      GROUP BY r, doc_id, template, start, of_
      HAVING count(DISTINCT shingle) >= {CONTAINED} * of_)
SELECT doc_id, template, CAST(start AS BIGINT) AS start_word, CAST(shared AS BIGINT) AS shared,
       CAST(of_ AS BIGINT) AS of_shingles
FROM g QUALIFY row_number() OVER (PARTITION BY r, template ORDER BY shared DESC, start) = 1
"""
