"""Lineage cuts and size-checked lookups shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_ROWS = 100_000
# Folders of the tables that `stage` has written in this process and nobody has released.
_staged: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names for checkpoints; a local one only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="flowkit-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(spark: SparkSession, rdd: RDD) -> None:
    """Have the next job on `rdd` write it to the shared folder too, which cuts its lineage.

    `release` removes the file that `rdd.getCheckpointFile()` names then.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    rdd.checkpoint()
    _staged.append(f"{sc.getCheckpointDir()}/rdd-{rdd.id()}")


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged tables that no DataFrame still in use reads."""
    for path in paths:
        if path in _staged:
            _staged.remove(path)
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_all_but(df: DataFrame) -> None:
    """Remove all staged tables, if `df` reads none of them."""
    if _staged and not any(p.split(":")[-1].lstrip("/") in f for f in df.inputFiles() for p in _staged):
        release(df.sparkSession, list(_staged))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables staged inside when it ends; names added to the list given are kept.

    Use it where the result is itself staged, so that nothing lazy still reads the others.
    """
    before, kept = set(_staged), []
    try:
        yield kept
    finally:
        release(spark, [p for p in _staged if p not in before and p not in kept])


def stage_result(df: DataFrame, kept: list[str]) -> DataFrame:
    """`stage` for the result of a `scratch` block."""
    out = stage(df)
    kept.append(_staged[-1])
    return out


def bounded(small: DataFrame, max_rows: int = LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a parameter table whose size is expected to be small.

    Fetches at most `max_rows` + 1 rows. Within the bound the result is a literal relation of
    known size; beyond it, the table is staged and stays distributed.
    """
    rows = small.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return small.sparkSession.createDataFrame(rows, schema=small.schema), True
    return stage(small), False


def join_groups(
    df: DataFrame, table: DataFrame, on: list[str], how: str = "inner"
) -> DataFrame:
    """Inner or left join on keys by name in which a null key meets a null key."""
    names = {k: f"__on_{n}__" for n, k in enumerate(on)}
    table = table.withColumnsRenamed(names)
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()])
    return df.join(table, same, how).drop(*names.values())


def lookup(
    df: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
    max_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """Join with a parameter table: broadcast within the bound, shuffled join beyond it.

    A null key meets a null key, as it does when the table is made by grouping.
    """
    table, fits = bounded(small, max_rows)
    return join_groups(df, F.broadcast(table) if fits else table, on, how)
