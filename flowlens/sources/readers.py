"""Flow files, manifests, traces and statistics as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.times import day_from_path
from flowlens.schema import FLOW_SCHEMA, LABEL, MANIFEST_SCHEMA, TRACE_SCHEMA

CORRUPT = "_corrupt_record"


def read_flow_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema=FLOW_SCHEMA,
    partitions: int | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Daily CSV files, plain or gzip, with a declared schema (DDL text).

    A gzip file is read by one task; `partitions` spreads its rows for the work after it.
    Fields that do not parse become NULL; `keep_corrupt` also keeps the text of such rows
    in `_corrupt_record`.
    """
    if keep_corrupt:
        schema = f"{schema}, {CORRUPT} string"
        columns = [*columns, CORRUPT] if columns else None
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("escape", '"')
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    rows = rows.select(*columns) if columns else rows
    return rows.repartition(partitions) if partitions else rows


def read_flow_parquet(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet files, a folder or an explicit list; a missing path is an error."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return rows.select(*columns) if columns else rows


def read_day(spark: SparkSession, path: str, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """One day, CSV or Parquet: asked columns plus the label, unlabelled rows dropped."""
    names = list(dict.fromkeys([*columns, label]))
    parquet = path.rstrip("/").endswith(".parquet")
    rows = read_flow_parquet(spark, path, names) if parquet else read_flow_csv(spark, path, names)
    return rows.filter(F.col(label).isNotNull())


def read_folder(
    spark: SparkSession, folder: str, columns: Sequence[str] | None = None, recursive: bool = True
) -> DataFrame:
    """All Parquet files below a folder; an empty folder is an error."""
    rows = (
        spark.read.option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", "*.parquet")
        .parquet(folder)
    )
    return rows.select(*columns) if columns else rows


def resolve_paths(base: str, files: Sequence[str]) -> list[str]:
    """Sorted file list, relative names taken below `base`."""
    absolute = [f if f.startswith("/") or "://" in f else f"{base.rstrip('/')}/{f}" for f in files]
    return sorted(absolute)


def read_listed(
    spark: SparkSession, base: str, files: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    if not files:
        raise ValueError("no files listed")
    return read_flow_parquet(spark, resolve_paths(base, files), columns)


def with_source(df: DataFrame) -> DataFrame:
    """Add the source file and the day in its name."""
    return df.withColumn("source_file", F.input_file_name()).withColumn(
        "day", day_from_path(F.col("source_file"))
    )


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy(F.input_file_name().alias("source_file")).agg(F.count(F.lit(1)).alias("rows"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Split manifest, one row per split."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def read_traces(spark: SparkSession, path: str, as_list: bool = False) -> DataFrame:
    """Trace rows, one JSON object per line, or one JSON list per file with `as_list`.

    No traces at all is an error.
    """
    traces = spark.read.schema(TRACE_SCHEMA).option("multiLine", as_list).json(path)
    if traces.isEmpty():
        raise ValueError(f"no traces in {path}")
    return traces


def read_service_map(spark: SparkSession, path: str) -> DataFrame:
    """Service to provider table."""
    return spark.read.option("header", True).csv(path)


def read_statistics(spark: SparkSession, path: str, schema) -> DataFrame:
    """Saved and seen counts that accompany each flow file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
