"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


# Settings that may change while a session runs.
RUNTIME = {
    # Flow times carry no zone.
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles methods above 8000 bytes; wide feature projections would run
    # interpreted, so let Spark split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Flow aggregates hold a few kilobytes each: keep thousands hashed before sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(name: str = "flowlens", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC clocks; `conf` overrides any setting."""
    settings = {
        **RUNTIME,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans here have many columns; recording a call site for each one is slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by `spark.checkpoint.dir`.

    A temporary folder stands in only when nothing is set and the session is local:
    on a cluster the executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="flowlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared scratch space."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df):
    """The table written out reliably, so later stages neither recompute nor re-split it."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
