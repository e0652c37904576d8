"""Reading inputs, settling intermediate tables in the shared folder, and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.session import scratch_path

#: A driver-side object is broadcast up to this size; beyond it the operators raise or work in parts.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet below spark.checkpoint.dir and read back.

    Cuts the lineage, survives lost executors and leaves a plain scan, so that a following join
    may be split where it is skewed. What a result still reads stays until the owner of the shared
    folder clears it after the job; tables of earlier steps are deleted by `release`.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def release(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads: all that was made from them is settled itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where the table has columns of that name already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators need, under fixed names; all other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def checked_broadcast(spark: SparkSession, value, size: int, what: str):
    """Broadcast an object of known size to Python workers, refusing one that is too large."""
    if size > BROADCAST_BYTES:
        raise ValueError(f"{what} takes {size} bytes; at most {BROADCAST_BYTES} are broadcast")
    return spark.sparkContext.broadcast(value)
