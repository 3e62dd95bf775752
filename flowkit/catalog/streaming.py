"""Queries for incremental cleaning (L1, L2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.registry import query
from flowkit.catalog.standins import (
    DIRTY_SPEC, TYPED, TYPED_BAD, TYPED_NEGATIVE, _DIRTY, _split_fields,
)
from flowkit.staging import shared_folder
from flowkit.streaming import flows as stream


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream of dirty text rows."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return stream.read_stream(spark, d, schema, glob="events.parquet", files_per_trigger=1)


@query("l1_clean_stream", f"""WITH {TYPED}
SELECT port, flag, round(value::DOUBLE, 4) + 0.0 AS value, round(spare::DOUBLE, 4) AS spare, "Label" FROM (
  SELECT DISTINCT port, flag, value, spare, "Label" FROM typed WHERE NOT {TYPED_BAD}
    AND "Label" <> 'Label' AND NOT ({TYPED_NEGATIVE}))""")
def l1(spark: SparkSession, d: str) -> DataFrame:
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    dirty = _arriving(spark, d).selectExpr(*_split_fields(_DIRTY))
    stream.clean_stream(dirty, DIRTY_SPEC, f"{base}/out", f"{base}/log").awaitTermination()
    return stream.finish_clean(spark, f"{base}/out").select(
        "port", "flag", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"),
        F.round(F.col("spare").cast("double"), 4).alias("spare"), "Label",
    )


@query("l2_running_label_counts", """SELECT event_type, count(*) AS rows FROM events GROUP BY event_type""")
def l2(spark: SparkSession, d: str) -> DataFrame:
    name = f"label_counts_{uuid.uuid4().hex}"
    stream.running_label_counts(_arriving(spark, d), "event_type", name).awaitTermination()
    return spark.table(name)


@query("l2_merged_label_counts", """SELECT event_type, count(*) AS rows FROM events GROUP BY event_type""")
def l2_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same counts in a table that survives the driver; the second run finds nothing new."""
    base = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    for _ in range(2):
        stream.merge_label_counts(
            _arriving(spark, d), "event_type", f"{base}/out", f"{base}/log").awaitTermination()
    return stream.read_label_counts(spark, f"{base}/out")
