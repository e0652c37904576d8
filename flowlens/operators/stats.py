"""Counts, class weights and normalization statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators.encode import Dictionary
from flowlens.operators.joins import join_same, settle

CHANNELS = 3
# Fixed value: smallest variance, so that no feature is divided by zero.
MIN_VARIANCE = 1e-6


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def class_weights(df: DataFrame, label: str, labels: Dictionary) -> DataFrame:
    """Balanced weight rows / (classes * count) for every class of the dictionary."""
    counts = class_counts(df, label)
    classes = labels.frame.withColumnRenamed("value", label)
    full = join_same(classes, counts, [label], "left")
    total = counts.agg(F.sum("rows")).scalar()
    size = labels.frame.agg(F.count(F.lit(1))).scalar()
    held = F.greatest(F.coalesce(F.col("rows"), F.lit(0)), F.lit(1))
    return full.select(
        label,
        "index",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        (total.cast("double") / (size * held)).alias("weight"),
    )


def with_class_weight(df: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    side, small = settle(weights.select(label, "weight"))
    return join_same(df, side, [label], "inner", small=small)


def _sequence_sums(channels: int) -> tuple[list[str], list[str]]:
    """Per-row folds of the real packets of each channel, and the sums over all rows."""
    folds, sums = ["valid_length"], ["sum(valid_length) AS sn"]
    for i in range(channels):
        real = f"slice(sequences[{i}], 1, valid_length)"
        folds.append(f"aggregate({real}, 0D, (s, x) -> s + x) AS sv{i}")
        folds.append(f"aggregate({real}, 0D, (s, x) -> s + x * x) AS sq{i}")
        sums += [f"sum(sv{i}) AS sv{i}", f"sum(sq{i}) AS sq{i}"]
    return folds, sums


def _tabular_sums(width: int) -> tuple[list[str], list[str]]:
    values = [f"get(tabular, {i}) AS x{i}" for i in range(width)]
    sums = ["count(1) AS tn"]
    for i in range(width):
        sums += [f"sum(x{i}) AS tv{i}", f"sum(x{i} * x{i}) AS tq{i}"]
    return values, sums


def _moments(totals: DataFrame, parts: dict[str, int]) -> DataFrame:
    """Means and deviations from one row of sums; `parts` gives the values per prefix."""
    entries = [
        f"struct('{p}' AS part, {i} AS position, {p}n AS n, {p}v{i} AS v, {p}q{i} AS q)"
        for p, width in parts.items()
        for i in range(width)
    ]
    long_form = totals.selectExpr(f"inline(array({', '.join(entries)}))")
    count = F.greatest(F.col("n"), F.lit(1))
    mean = F.coalesce(F.col("v"), F.lit(0.0)) / count
    variance = F.coalesce(F.col("q"), F.lit(0.0)) / count - mean * mean
    std = F.sqrt(F.greatest(variance, F.lit(MIN_VARIANCE)))
    return long_form.select("part", "position", mean.alias("mean"), std.alias("std"))


def sequence_stats(samples: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """Mean and standard deviation per channel over real packets only, one row per channel.

    Each row is folded to its own sums first; packets are never exploded.
    """
    folds, sums = _sequence_sums(channels)
    return _moments(samples.selectExpr(*folds).selectExpr(*sums), {"s": channels}).drop("part")


def tabular_stats(samples: DataFrame, width: int) -> DataFrame:
    """Mean and population standard deviation of every tabular value, one row per position."""
    values, sums = _tabular_sums(width)
    return _moments(samples.selectExpr(*values).selectExpr(*sums), {"t": width}).drop("part")


class Normalization:
    """Fitted means and deviations; a few dozen numbers that become literals in the plan."""

    def __init__(self, seq_mean: list, seq_std: list, tab_mean: list, tab_std: list):
        self.seq_mean, self.seq_std = seq_mean, seq_std
        self.tab_mean, self.tab_std = tab_mean, tab_std

    @classmethod
    def fit(cls, samples: DataFrame, width: int, channels: int = CHANNELS) -> "Normalization":
        """Both kinds of statistics in one pass over the samples."""
        folds, sequence_sums = _sequence_sums(channels)
        values, tabular_sums = _tabular_sums(width)
        totals = samples.selectExpr(*folds, *values).selectExpr(*sequence_sums, *tabular_sums)
        return cls.of_moments(_moments(totals, {"s": channels, "t": width}))

    @classmethod
    def of_moments(cls, moments: DataFrame) -> "Normalization":
        """From rows of part, position, mean and std: as many as there are channels and values."""
        rows = moments.orderBy("part", "position").collect()

        def listed(part: str, field: str) -> list:
            return [r[field] for r in rows if r["part"] == part]

        return cls(listed("s", "mean"), listed("s", "std"), listed("t", "mean"), listed("t", "std"))

    @classmethod
    def of_manifest(cls, manifest: DataFrame) -> "Normalization":
        """Statistics saved in a one-row split manifest."""
        saved = manifest.select("normalization.*").first()
        if saved is None or saved["seq_mean"] is None:
            raise ValueError("the manifest holds no normalization statistics")
        return cls(saved["seq_mean"], saved["seq_std"], saved["tab_mean"], saved["tab_std"])

    def apply(self, samples: DataFrame) -> DataFrame:
        """Z-scores of sequences and tabular values; padding is shifted like real packets."""
        sequences = F.array(
            *[
                F.transform(F.get("sequences", F.lit(i)), _scaled(mean, std))
                for i, (mean, std) in enumerate(zip(self.seq_mean, self.seq_std))
            ]
        )
        means = F.array(*[F.lit(float(m)) for m in self.tab_mean])
        stds = F.array(*[F.lit(max(float(s), 1e-6)) for s in self.tab_std])
        centred = F.zip_with("tabular", means, lambda x, m: x - m)
        tabular = F.zip_with(centred, stds, lambda x, s: x / s)
        return samples.withColumns({"sequences": sequences, "tabular": tabular})


class FileStatistics:
    """Normalization sums kept per file, so that a new file is merged without reading the old ones.

    The stored table has one row per file: counts, sums and sums of squares of every channel and
    tabular value. A file that comes again replaces its row.
    """

    def __init__(self, spark: SparkSession, path: str, width: int, channels: int = CHANNELS):
        self.spark, self.path, self.width, self.channels = spark, path, width, channels
        self._folds, sequence_sums = _sequence_sums(channels)
        self._values, tabular_sums = _tabular_sums(width)
        self._sums = [*sequence_sums, *tabular_sums]
        self._names = [part.rsplit(" AS ", 1)[1] for part in self._sums]

    def add(self, samples: DataFrame, file: str) -> None:
        """Sum the samples by their column `file` and store the sums."""
        rows = samples.selectExpr(f"`{file}` AS file", *self._folds, *self._values)
        sums = rows.groupBy("file").agg(*[F.expr(s) for s in self._sums])
        counts = [F.col(n).cast("long").alias(n) if n in ("sn", "tn") else F.col(n).cast("double").alias(n) for n in self._names]
        sums.select("file", *counts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(self.path)

    def files(self) -> DataFrame:
        """The stored sums, a row per file."""
        kinds = ", ".join(f"{n} {'long' if n in ('sn', 'tn') else 'double'}" for n in self._names)
        return self.spark.read.schema(f"{kinds}, file string").parquet(self.path)

    def moments(self) -> DataFrame:
        """part (`s` for channels, `t` for tabular values), position, mean and std over all files."""
        totals = self.files().agg(*[F.sum(n).alias(n) for n in self._names])
        return _moments(totals, {"s": self.channels, "t": self.width})

    def normalization(self) -> Normalization:
        return Normalization.of_moments(self.moments())


def _scaled(mean: float, std: float):
    return lambda x: (x - F.lit(float(mean))) / F.lit(max(float(std), 1e-6))


def partition_profile(df: DataFrame) -> DataFrame:
    """Partitions, rows and approximate bytes: total, smallest, largest, mean."""
    # Column lengths: text by its bytes, nested values by their elements, anything else 8 bytes.
    widths = [
        F.octet_length(c) if kind in ("string", "binary")
        else F.size(c) * 8 if kind.startswith(("array", "map"))
        else F.lit(8)
        for c, kind in df.dtypes
    ]
    size = sum((F.coalesce(w.cast("long"), F.lit(0)) for w in widths), F.lit(0).cast("long"))
    per_part = (
        df.select(F.spark_partition_id().alias("part"), size.alias("bytes"))
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    )
    return per_part.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.sum("rows").alias("rows"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        F.avg("rows").alias("mean_rows"),
        F.sum("bytes").alias("bytes"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct()


