"""Corpus pipeline: toxicity, near copies, repeated passages, mix, packing.

Each stage is written as Parquet and read again as the input of the next one. A stage begins by
removing the working tables of earlier ones, unless its input still reads them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowkit.llm import mixing, near_copies, packing, suffixes, toxicity
from flowkit.llm.common import table
from flowkit.staging import release_all_but, shared_folder

# Shortest repeated passage that is cut, in bytes. Passages of 50 words have 310 in the middle and 243 or more
# in 99 of 100 cases (sf0.1); the 400 of op6 bind that query only and pass over most of them.
PASSAGE_BYTES = 200


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_all_but(docs)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_all_but(docs)
    return near_copies.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_all_but(docs)
    return suffixes.without_repeats(docs, PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_all_but(docs)
    return mixing.mixed_rows(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_all_but(docs)
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

# Training, iterated links and suffix arrays cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    return docs
