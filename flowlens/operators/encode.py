"""Value dictionaries: sorted distinct values to dense indexes, and lookups both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowlens.operators.joins import BROADCAST_ROWS
from flowlens.session import checkpointed


class Dictionary:
    """Fitted value-to-index table with columns `value` and `index`."""

    def __init__(self, frame: DataFrame, small: bool):
        self.frame = frame
        self.small = small

    @classmethod
    def fit(
        cls, df: DataFrame, column: str, first: int = 0, broadcast_rows: int = BROADCAST_ROWS
    ) -> "Dictionary":
        """Number the distinct non-NULL values in ascending order, starting at `first`."""
        spark = df.sparkSession
        values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
        schema = T.StructType([*values.schema.fields, T.StructField("index", T.IntegerType())])
        # An unsorted head stops after the limit; only a short list is sorted here.
        head = values.limit(broadcast_rows + 1).collect()
        if len(head) <= broadcast_rows:
            rows = [(value, i) for i, value in enumerate(sorted(row["value"] for row in head), start=first)]
            return cls(spark.createDataFrame(rows, schema), small=True)
        return cls(_dense_index(values.orderBy("value"), first), small=False)

    @classmethod
    def of_values(cls, spark, values: list, first: int = 0, value_type=None) -> "Dictionary":
        """Dictionary from a saved list, in the saved order."""
        schema = T.StructType(
            [T.StructField("value", value_type or T.StringType()), T.StructField("index", T.IntegerType())]
        )
        rows = [(value, i) for i, value in enumerate(values, start=first)]
        return cls(spark.createDataFrame(rows, schema), small=len(rows) <= BROADCAST_ROWS)

    def _side(self, *columns) -> DataFrame:
        side = self.frame.select(*columns)
        return F.broadcast(side) if self.small else side

    def encode(self, df: DataFrame, column: str, index: str, missing: int | None = None) -> DataFrame:
        """Add the index; unknown and NULL values get `missing`, or are dropped without it."""
        side = self._side(F.col("value").alias("_value"), F.col("index").alias(index))
        how = "inner" if missing is None else "left"
        joined = df.join(side, F.col(column) == F.col("_value"), how).drop("_value")
        if missing is None:
            return joined
        return joined.withColumn(index, F.coalesce(index, F.lit(missing)))

    def decode(self, df: DataFrame, index: str, column: str) -> DataFrame:
        """Add the value of an index; an index outside the dictionary gives NULL."""
        side = self._side(F.col("value").alias(column), F.col("index").alias("_index"))
        return df.join(side, F.col(index) == F.col("_index"), "left").drop("_index")

    def keep_known(self, df: DataFrame, column: str) -> DataFrame:
        side = self._side(F.col("value").alias("_value"))
        return df.join(side, F.col(column) == F.col("_value"), "left_semi")

    def unseen(self, df: DataFrame, column: str) -> DataFrame:
        """Distinct non-NULL values that the dictionary lacks."""
        values = df.filter(F.col(column).isNotNull()).select(column).distinct()
        side = self._side(F.col("value").alias("_value"))
        return values.join(side, F.col(column) == F.col("_value"), "left_anti")

    def values(self) -> list:
        """The values in index order, as a list on the driver; joins do not need it."""
        return [row["value"] for row in self.frame.orderBy("index").collect()]


def _dense_index(ordered: DataFrame, first: int) -> DataFrame:
    """Number a sorted table of any size: position in its partition plus earlier counts."""
    placed = checkpointed(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition of the sort.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).select(
        "value", (F.col("_offset") + inside + first).cast("int").alias("index")
    )


def overlap(evaluation: DataFrame, training: DataFrame, column: str) -> DataFrame:
    """Evaluation rows whose label also occurs in training; an error if there are none."""
    kept = Dictionary.fit(training, column).keep_known(evaluation, column)
    if kept.isEmpty():
        raise ValueError("training and evaluation data share no label")
    return kept


def shared_labels(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Labels that occur on both sides."""
    known = F.col(column).isNotNull()
    return left.filter(known).select(column).intersect(right.filter(known).select(column))


def one_hot(df: DataFrame, index: str, size: int, name: str) -> DataFrame:
    """Indicator array of a bounded index: position i is 1 for index i."""
    return df.withColumn(
        name,
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == F.col(index)).cast("double")),
    )
