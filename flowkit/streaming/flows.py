"""Incremental cleaning of arriving files. Row-wise only, so the stream keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowkit.functions import col, safe_label
from flowkit.operators.clean import clean_rows
from flowkit.operators.dedup import dedup
from flowkit.spec import DatasetSpec


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
    glob: str | None = None, files_per_trigger: int | None = None, **options: str,
) -> DataFrame:
    """Files as a stream; all of them must share one header."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def clean_stream(
    source: DataFrame, spec: DatasetSpec, out: str, checkpoint: str
) -> StreamingQuery:
    """Clean what has arrived since the last run and append it by label, exactly once.

    De-duplication without a watermark would keep unbounded state, so it is a batch step:
    `finish_clean`.
    """
    rows = clean_rows(source, spec).withColumn("label_safe", safe_label(col(spec.label)))
    return (
        rows.writeStream.format("parquet").outputMode("append").partitionBy("label_safe")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def finish_clean(spark: SparkSession, out: str) -> DataFrame:
    """Distinct cleaned rows of everything the stream has written."""
    return dedup(spark.read.parquet(out).drop("label_safe"))


def running_label_counts(
    source: DataFrame, label: str, table: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Row counts per label, updated with every batch of files, as an in-memory table."""
    counts = source.groupBy(col(label)).agg(F.count("*").alias("rows"))
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(table)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def merge_label_counts(
    source: DataFrame, label: str, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Row counts per label in a table in `out`, brought forward by every batch of files.

    Batch n adds its counts to the totals of batch n - 1 and writes `v=n`. A batch that is run again
    after a failure reads the same totals and replaces its own folder, so every file counts once;
    the totals before the last two are removed. Null labels are counted as a label.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy(col(label)).agg(F.count("*").alias("rows"))
        if number > 0:
            counts = counts.unionByName(spark.read.schema(counts.schema).parquet(f"{out}/v={number - 1}"))
        totals = counts.groupBy(col(label)).agg(F.sum("rows").alias("rows"))
        totals.write.mode("overwrite").parquet(f"{out}/v={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/v={number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_label_counts(spark: SparkSession, out: str) -> DataFrame | None:
    """The newest complete totals, or None before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    done = [p for p in (s.getPath() for s in files.listStatus(folder))
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    newest = max((int(p.getName().split("=")[1]) for p in done), default=None)
    return None if newest is None else spark.read.parquet(f"{out}/v={newest}")
