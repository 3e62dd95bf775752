"""Reading and writing flow tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from flowkit.functions import col, safe_label
from flowkit.operators.clean import drop_repeated_headers, filter_labels
from flowkit.staging import lookup

__all__ = [
    "discover_sources", "drop_repeated_headers", "list_inputs", "load_params", "majority_schema",
    "parse_source_name", "pick_model_variant", "read_flows", "read_header", "read_headerless",
    "read_preferring", "read_subset", "require_all_sources", "save_params", "schema_drift",
    "split_to_label_tables", "write_by_label", "write_metrics", "write_table",
]

CSV_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "true", "quote": '"', "escape": '"'}


# ---- files and headers ----------------------------------------------------------------------

def list_inputs(spark: SparkSession, folder: str, ext: str = ".csv") -> DataFrame:
    """(path, file_order): files with the extension in any case, sorted; an error when empty."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    # only the path is read, so the content stays where it is
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    if files.isEmpty():
        raise FileNotFoundError(f"no {ext} files in {folder}")
    order = Window.partitionBy(F.lit(0)).orderBy("path")
    return files.withColumn("file_order", F.row_number().over(order))


def header_names(line: Column) -> Column:
    """Column names of one header line, both ends stripped."""
    cells = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')  # commas outside quotes
    bare = lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', ""))
    return F.transform(cells, lambda x: F.replace(bare(x), F.lit('""'), F.lit('"')))


def read_header(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, file_order, header): the first line of each file, a few bytes each."""
    listed = files.orderBy("file_order").collect()
    with ThreadPool(8) as pool:
        lines = pool.map(lambda r: spark.read.text(r["path"]).first(), listed)
    rows = [
        (r["path"], r["file_order"], line["value"] if line else "")
        for r, line in zip(listed, lines)
    ]
    table = spark.createDataFrame(rows, "path string, file_order int, line string")
    return table.select("path", "file_order", header_names(F.col("line")).alias("header"))


def majority_schema(headers: DataFrame) -> DataFrame:
    """One row (header, files): the most frequent ordered header, ties by first file."""
    return (
        headers.groupBy("header")
        .agg(F.count("*").alias("files"), F.min("file_order").alias("first"))
        .orderBy(F.desc("files"), F.asc("first")).limit(1)
    )


def schema_drift(headers: DataFrame, majority: DataFrame) -> DataFrame:
    """Files that deviate, with their extra and missing columns."""
    voted = majority.select("header").scalar()
    return (
        headers.withColumn("__m__", voted).where(F.col("header") != F.col("__m__"))
        .select(
            *[c for c in headers.columns if c != "header"],
            F.array_except("header", "__m__").alias("extra"),
            F.array_except("__m__", "header").alias("missing"),
        )
        .withColumn("n_extra", F.size("extra")).withColumn("n_missing", F.size("missing"))
    )


def read_flows(
    spark: SparkSession, headers: DataFrame, wanted: Sequence[str], file: str = "__file__"
) -> DataFrame:
    """All files as text columns, only the wanted ones, gaps as null.

    Files are read in groups of equal headers, since a CSV scan maps columns by position.
    """
    groups = headers.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    parts = []
    for g in sorted(groups, key=lambda g: min(g["paths"])):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in g["header"]])
        rows = spark.read.options(**CSV_OPTIONS).schema(schema).csv(sorted(g["paths"]))
        parts.append(rows.select(
            *[col(c) if c in g["header"] else F.lit(None).cast("string").alias(c) for c in wanted],
            F.col("_metadata.file_name").alias(file),
        ))
    return reduce(DataFrame.unionByName, parts)


def read_headerless(
    spark: SparkSession, path: str, names: Sequence[str], numeric: Sequence[str] = ()
) -> DataFrame:
    """CSV without header; the names are given."""
    kind = {n: T.DoubleType() for n in numeric}
    schema = T.StructType([T.StructField(n, kind.get(n, T.StringType())) for n in names])
    return spark.read.schema(schema).csv(path, header=False)


# ---- per-label tables -----------------------------------------------------------------------

def write_by_label(
    df: DataFrame, path: str, label: str = "Label", extra: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """One partition per safe label name.

    The rebalance hint lets AQE merge small pieces and split a hot label over many files.
    """
    out = df.withColumn("label_safe", safe_label(col(label)))
    out.hint("rebalance", "label_safe").write.mode(mode).partitionBy(*extra, "label_safe").parquet(path)


def split_to_label_tables(
    df: DataFrame, known: Sequence[str], path: str | None = None, label: str = "Label"
) -> DataFrame:
    """Rows of the configured labels, written by label when a path is given."""
    rows = filter_labels(df, label, known)
    if path is not None:
        write_by_label(rows, path, label)
    return rows.withColumn("label_safe", safe_label(col(label)))


def read_subset(
    spark: SparkSession, path: str, subset: str | None = None,
    labels: Sequence[str] | None = None, variant: str | None = None,
) -> DataFrame:
    """Rows of one subset, labels and variant; the conditions prune partitions."""
    df = spark.read.parquet(path)
    if subset is not None:
        df = df.where(F.col("subset") == subset)
    if variant is not None:
        df = df.where(F.col("variant") == variant)
    if labels is not None:
        safe = [x.lower().replace(" ", "_").replace("/", "_") for x in labels]
        df = df.where(F.col("label_safe").isin(*safe))
    return df


def _rank_of(c: Column, preference: Sequence[str]) -> Column:
    ranks = [F.when(c == v, F.lit(i)) for i, v in enumerate(preference)]
    return F.coalesce(*ranks)


def read_preferring(
    df: DataFrame, preference: Sequence[str] = ("compressed", "full"), label: str = "Label",
    variant: str = "variant",
) -> DataFrame:
    """Per label only the rows of the most preferred variant that exists."""
    ranked = df.withColumn("__rank__", _rank_of(col(variant), preference)).where(
        F.col("__rank__").isNotNull()
    )
    best = ranked.groupBy(col(label)).agg(F.min("__rank__").alias("__rank__"))
    return lookup(ranked, best, [label, "__rank__"]).select(*df.columns)


# ---- sources of perturbed samples and models ------------------------------------------------

def parse_source_name(file: Column, resource: str, model: str) -> Column:
    """Attack from `<resource>_<model>_<attack>_adv.csv`, else the file stem."""
    name = F.regexp_extract(file, "([^/]*)$", 1)
    attack = F.regexp_extract(name, f"^\\Q{resource}_{model}_\\E(.*)_adv\\.csv$", 1)
    stem = F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
    return F.when(attack != "", attack).otherwise(stem)


def discover_sources(
    files: DataFrame, model: str, fallback: str = "dnn", attacks: Sequence[str] | None = None
) -> DataFrame:
    """(attack, path): the model's own file per attack, else the fallback model's.

    `files` is (model, attack, path). A list of attacks restricts the result.
    """
    own = files.where(F.col("model") == model).groupBy("attack").agg(F.min("path").alias("own"))
    other = files.where(F.col("model") == fallback).groupBy("attack").agg(
        F.min("path").alias("other")
    )
    found = own.join(other, "attack", "full_outer").select(
        "attack", F.coalesce("own", "other").alias("path")
    )
    return found if attacks is None else found.where(F.col("attack").isin(*attacks))


def require_all_sources(files: DataFrame, models: Sequence[str]) -> DataFrame:
    """Attacks for which every listed model has data."""
    return (
        files.where(F.col("model").isin(*models)).groupBy("attack")
        .agg(F.count_distinct("model").alias("models"))
        .where(F.col("models") == len(set(models)))
    )


def pick_model_variant(
    paths: DataFrame, preference: Sequence[str] = ("isolated_robust", "robust", "base"),
    model: str = "model", variant: str = "variant",
) -> DataFrame:
    """Per model the first available variant in the order of preference.

    The aggregate keeps one row per model, whatever number of files a model has.
    """
    ranked = paths.withColumn("__rank__", _rank_of(col(variant), preference)).where(
        F.col("__rank__").isNotNull()
    )
    rest = [c for c in paths.columns if c != model]
    first = F.min_by(F.struct(*[col(c) for c in rest]), F.struct("__rank__", *[col(c) for c in rest]))
    return ranked.groupBy(col(model)).agg(first.alias("__f__")).select(col(model), "__f__.*")


# ---- parameters, metrics, plain tables ------------------------------------------------------

def save_params(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_params(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame] | None:
    """The saved tables, or nothing when one is absent."""
    try:
        return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    except AnalysisException:
        return None


def write_metrics(df: DataFrame, path: str, per: str | None = None) -> None:
    """Metric rows as JSON; with `per`, one folder per value of that column."""
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.partitionBy(per) if per else writer).json(path)


def write_table(df: DataFrame, path: str, order: str | None = None, mode: str = "overwrite") -> None:
    """Full table as Parquet, range-partitioned and sorted when an order column is given."""
    out = df if order is None else df.repartitionByRange(col(order)).sortWithinPartitions(col(order))
    out.write.mode(mode).parquet(path)
