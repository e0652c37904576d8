"""Feature tables kept by the content they come from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


class FeatureCache:
    """Feature tables below a shared folder, one per source file and list of features.

    The key covers path, length and time of change of every file of the source and the names of the
    features in order, so a changed file or list never meets an old table. A table counts once its
    writer has committed; what a broken writer left is written over.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, source: str) -> list[tuple[str, int, int]]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(source)
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(folder, True) if self._exists(source) else None
        if found is None:
            raise FileNotFoundError(source)
        out = []
        while found.hasNext():
            status = found.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        return sorted(out)

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def path(self, source: str, features: Sequence[str]) -> str:
        key = json.dumps([self._files(source), list(features)])
        return f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()}"

    def get(self, source: str, features: Sequence[str], build: Callable[[str], DataFrame]) -> tuple[DataFrame, bool]:
        """The features of a source file or folder, and whether they were there already.

        `build` makes the table from the source on a miss; it is not called on a hit.
        """
        path = self.path(source, features)
        hit = self._exists(f"{path}/_SUCCESS")
        if not hit:
            build(source).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), hit
