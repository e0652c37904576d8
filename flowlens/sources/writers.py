"""Parquet conversion, feature tables, manifests and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.times import day_from_path, parquet_name
from flowlens.operators.encode import Dictionary
from flowlens.operators.stats import Normalization, class_counts
from flowlens.schema import FLOW_SCHEMA, MANIFEST_SCHEMA, SEQUENCE_LENGTH
from flowlens.sources.readers import read_flow_csv

# Fixed value: layout version written into manifests.
MANIFEST_VERSION = 2


def csv_to_parquet(
    spark: SparkSession,
    paths: str | Sequence[str],
    output: str,
    columns: Sequence[str] | None = None,
    schema=FLOW_SCHEMA,
) -> DataFrame:
    """Convert all CSV files in one job and return rows per source file.

    The output is partitioned by source file and day, so a later filter on either reads
    only its own files. An empty input leaves an empty table with the asked columns.
    """
    rows = read_flow_csv(spark, paths, columns, schema)
    source = F.input_file_name()
    named = rows.withColumns({"source": parquet_name(source), "day": day_from_path(source)})
    named.write.mode("overwrite").option("compression", "snappy").partitionBy("day", "source").parquet(output)
    layout = named.schema
    if not _has_files(spark, output):
        spark.createDataFrame([], layout).write.mode("overwrite").parquet(output)
    written = spark.read.schema(layout).parquet(output)
    return written.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).orderBy("source")


def _has_files(spark: SparkSession, folder: str) -> bool:
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(folder)
        .select("path")
    )
    return not listing.isEmpty()


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table as snappy Parquet and return it as read back."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_features(df: DataFrame, root: str, version: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Feature table under a path that names the feature set version."""
    return write_table(df, f"{root.rstrip('/')}/features-{version}", partition_by)


def manifest(
    samples: DataFrame,
    split: str,
    labels: Dictionary,
    versions: Dictionary,
    normalization: Normalization,
    width: int,
    files: DataFrame | None = None,
) -> DataFrame:
    """The one-row split manifest of a sample table with `label_id`."""
    spark = samples.sparkSession
    names = labels.values()
    counts = class_counts(samples, "label_id")
    # One row per class.
    found = {r["label_id"]: r["rows"] for r in counts.collect()}
    total = sum(found.values())
    if not total:
        raise ValueError(f"no usable samples for split {split}")
    chunks = [] if files is None else [(r["file"], r["rows"]) for r in files.collect()]
    row = (
        split,
        total,
        SEQUENCE_LENGTH,
        width,
        len(names),
        {name: i for i, name in enumerate(names)},
        names,
        versions.values(),
        [found.get(i, 0) for i in range(len(names))],
        (normalization.seq_mean, normalization.seq_std, normalization.tab_mean, normalization.tab_std),
        chunks,
        MANIFEST_VERSION,
    )
    return spark.createDataFrame([row], MANIFEST_SCHEMA)


def write_json(df: DataFrame, path: str) -> None:
    """Small metadata tables as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "compression", compression
    ).csv(path)


