"""Local session for tests, the bench and notebooks. A cluster brings its own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = "*", partitions: int = 8, memory: str = "12g", checkpoint: str | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowkit")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
