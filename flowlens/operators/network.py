"""Class-weighted dense networks, fitted by gradients that tasks sum over their rows.

A step is one aggregation: every task computes the weighted gradient of its rows, the sums are merged in
blocks of parameters, and the driver, which holds the parameters alone, moves them (Adam with decoupled
decay). Rows of a step and dropped units follow from hashes of the row's key, so a task that runs again
gives the same sums, and results do not depend on how rows are dealt out but for the last digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.operators.boosting import ROWS_PER_TASK, softmax
from flowlens.operators.encode import Dictionary
from flowlens.operators.stats import class_weights
from flowlens.schema import LABEL, SEQUENCE_LENGTH
from flowlens.session import scratch_path

#: Inputs before the tabular values: three channels of a sequence.
SEQUENCE_INPUTS = 3 * SEQUENCE_LENGTH
#: Rows of a batch whose activations are held together.
SLICE = 4096
#: Bytes of partial sums that meet in one task.
MERGE_BYTES = 64 << 20
#: Bytes of partial sums that the driver adds up itself.
DRIVER_BYTES = 8 << 20
#: Bytes of parameters that are sent to the tasks.
MODEL_BYTES = 256 << 20
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Settings:
    """Fixed values of the reference configuration: epochs, warm-up, decay, clip, dropout and smoothing.

    The step size is larger than there, since a step covers one of `steps` shares of all rows, not a few thousand.
    `sequence_only` reads the tabular values and the version as zeros, in fitting and scoring.
    """

    epochs: int = 25
    steps: int = 4
    hidden: tuple[int, ...] = (128,)
    rate: float = 0.01
    warmup: int = 4
    decay: float = 1e-4
    clip: float = 1.0
    dropout: float = 0.3
    smoothing: float = 0.05
    balanced: bool = True
    sequence_only: bool = False
    seed: int = 42


def rate(settings: Settings, epoch: int) -> float:
    """Linear from a tenth during the warm-up, then half a cosine down to zero."""
    if epoch < settings.warmup:
        return settings.rate * (0.1 + 0.9 * epoch / settings.warmup)
    return settings.rate * 0.5 * (1 + math.cos(math.pi * (epoch - settings.warmup) / max(settings.epochs - settings.warmup, 1)))


@dataclass
class Parameters:
    """All weights and biases as one vector; `sizes` are the widths of the layers."""

    sizes: list[int]
    values: np.ndarray

    @classmethod
    def first(cls, sizes: Sequence[int], seed: int) -> "Parameters":
        """Random hidden layers; the last one starts at zero, so all classes start equally likely."""
        rng = np.random.default_rng(seed)
        parts = []
        for i, (n, m) in enumerate(zip(sizes, sizes[1:])):
            spread = 0.0 if i == len(sizes) - 2 else math.sqrt(2.0 / n)
            parts += [(rng.standard_normal((n, m)) * spread).ravel(), np.zeros(m)]
        return cls(list(sizes), np.concatenate(parts))

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for n, m in zip(self.sizes, self.sizes[1:]):
            out.append((self.values[at : at + n * m].reshape(n, m), self.values[at + n * m : at + n * m + m]))
            at += n * m + m
        return out


def uniform(keys: np.ndarray, number: int, columns: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) by row key, column and number of the draw."""
    u = np.uint64
    x = keys.view(u)[:, None] ^ u((seed * 0x9E3779B97F4A7C15 + number * 0xD6E8FEB86659FD93) & (2**64 - 1))
    x = x + np.arange(1, columns + 1, dtype=u) * u(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(shift))) * u(factor)
    return (x >> u(11)).astype(np.float64) / 2**53


def forward(layers, x: np.ndarray, masks: Sequence[np.ndarray] | None = None) -> list[np.ndarray]:
    """The inputs of every layer and the class probabilities at the end."""
    held = [x]
    for i, (w, b) in enumerate(layers):
        z = held[-1] @ w + b
        if i == len(layers) - 1:
            held.append(softmax(z))
        else:
            z = np.maximum(z, 0.0)
            held.append(z if masks is None else z * masks[i])
    return held


def losses(p: np.ndarray, y: np.ndarray, weights: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted cross entropy of each row, and its gradient by the inputs of the softmax."""
    n = p.shape[1]
    target = np.full_like(p, smoothing / n)
    target[np.arange(len(y)), y] += 1.0 - smoothing
    target *= weights
    loss = -(target * np.log(np.maximum(p, 1e-15))).sum(axis=1)
    return loss, p * target.sum(axis=1, keepdims=True) - target


def gradient(parameters: Parameters, x, y, weights, smoothing: float, masks=None) -> tuple[float, np.ndarray]:
    """Summed loss of the rows and its gradient by all parameters."""
    layers = parameters.layers()
    held = forward(layers, x, masks)
    loss, d = losses(held[-1], y, weights, smoothing)
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(held[i].T @ d).ravel(), d.sum(axis=0), *parts]
        if i:
            d = (d @ layers[i][0].T) * (held[i] > 0)
            if masks is not None:
                d = d * masks[i - 1]
    return float(loss.sum()), np.concatenate(parts)


def drop_masks(keys: np.ndarray, number: int, hidden: Sequence[int], settings: Settings) -> list[np.ndarray] | None:
    """Kept units of the hidden layers, scaled up for those that are dropped."""
    if not settings.dropout:
        return None
    kept = 1.0 - settings.dropout
    chosen = uniform(keys, 2 * number + 1, sum(hidden), settings.seed) < kept
    return np.split(chosen / kept, np.cumsum(hidden)[:-1], axis=1)


def of_step(keys: np.ndarray, epoch: int, step: int, settings: Settings) -> np.ndarray:
    """Rows of a step; each epoch deals all rows to its steps anew."""
    return (uniform(keys, 2 * epoch, 1, settings.seed)[:, 0] * settings.steps).astype(int) == step


@dataclass
class Network:
    """A fit: parameters of the best epoch, those of the last one with its momenta, and metrics by epoch."""

    labels: list[str]
    weights: list[float]
    settings: Settings
    best: Parameters
    last: Parameters
    momenta: np.ndarray
    history: list[tuple] = field(default_factory=list)
    chosen: int = 0

    def epochs(self) -> DataFrame:
        """epoch, rows, loss and accuracy of training and validation rows, and the chosen epoch."""
        schema = (
            "epoch int, train_rows long, train_loss double, train_accuracy double, "
            "valid_rows long, valid_loss double, valid_accuracy double"
        )
        table = SparkSession.active().createDataFrame(self.history, schema)
        return table.withColumn("chosen", F.col("epoch") == self.chosen)

    def score(self, rows: DataFrame, keep: Sequence[str] = (), vector: str = "inputs") -> DataFrame:
        """`keep` with class probabilities (in the order of the labels) and y_pred, first label on ties."""
        keep = list(keep)
        held = rows.select(*keep, _floats(F.col(vector), self.settings).alias("_x"))
        schema = held.drop("_x").schema.add("probabilities", T.ArrayType(T.DoubleType())).add("y_pred", T.StringType())
        layers, labels = self.best.layers(), self.labels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    p = forward(layers, _matrix(batch.column(len(keep)), layers[0][0].shape[0]))[-1]
                    ends = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(p.ravel()))
                    guess = pa.array([labels[i] for i in p.argmax(axis=1)], pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists, guess], names=[*keep, "probabilities", "y_pred"])

        return held.mapInArrow(run, schema)

    def save(self, path: str) -> None:
        """All that scoring and further epochs need, as one row."""
        sizes, s = self.best.sizes, self.settings
        row = (
            self.labels, self.weights, sizes, *(v.tolist() for v in (self.best.values, self.last.values, self.momenta.ravel())),
            self.history, self.chosen, repr(s),
        )
        SparkSession.active().createDataFrame([row], _STORED).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Settings) -> "Network":
        """The stored network; other settings than it was fitted with are an error."""
        row = spark.read.schema(_STORED).parquet(path).first()
        if row is None or row["settings"] != repr(settings):
            raise ValueError(f"the network at {path} was fitted with other settings: {row and row['settings']}")
        values = [np.array(row[c]) for c in ("best", "last", "momenta")]
        best, last = (Parameters(list(row["sizes"]), x) for x in values[:2])
        history = [tuple(h) for h in row["history"]]
        return cls(list(row["labels"]), list(row["weights"]), settings, best, last, values[2].reshape(2, -1), history, row["chosen"])


_STORED = (
    "labels array<string>, weights array<double>, sizes array<int>, best array<double>, last array<double>, momenta array<double>, "
    "history array<struct<epoch:int,train_rows:long,train_loss:double,train_accuracy:double,"
    "valid_rows:long,valid_loss:double,valid_accuracy:double>>, chosen int, settings string"
)


def _floats(vector, settings: Settings):
    """Inputs as floats; unknown values are 0, and so is all behind the sequences in the sequence-only mode."""
    known = F.transform(vector, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float"))
    if not settings.sequence_only:
        return known
    return F.transform(known, lambda x, i: F.when(i < SEQUENCE_INPUTS, x).otherwise(F.lit(0.0).cast("float")))


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if values.null_count or len(flat) != len(values) * width:
        raise ValueError(f"every row needs {width} inputs")
    return flat.reshape(len(values), width).astype(np.float64)


def summed(rows: DataFrame, parts: int, size: int, of_batch) -> np.ndarray:
    """The `size` sums that `of_batch` gives for each batch of the rows, added up in the order of the `parts` tasks."""
    block = max(256, min(size, MERGE_BYTES // (8 * parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                total += of_batch(whole.slice(at, SLICE))
        cuts = range(0, size, block)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(cuts)), pa.int32()), pa.array([part] * len(cuts), pa.int32()),
             pa.array([total[c : c + block].tobytes() for c in cuts], pa.binary())], names=["block", "part", "total"])

    def added(totals: list[tuple[int, bytes]]) -> np.ndarray:
        return sum(np.frombuffer(total) for _, total in sorted(totals))

    def merge(table: pa.Table) -> pa.Table:
        merged = added(zip(table.column("part").to_pylist(), table.column("total").to_pylist()))
        return pa.table({"block": table.column("block").slice(0, 1), "total": pa.array([merged.tobytes()], pa.binary())})

    partial = rows.mapInArrow(run, "block int, part int, total binary")
    if 8 * parts * size > DRIVER_BYTES:
        partial = partial.groupBy("block").applyInArrow(merge, "block int, total binary").withColumn("part", F.lit(0))
    blocks: dict[int, list] = {}
    for r in partial.collect():
        blocks.setdefault(r["block"], []).append((r["part"], r["total"]))
    return np.concatenate([added(blocks[b]) for b in sorted(blocks)]) if blocks else np.zeros(size)


class _Rows:
    """The stored rows (key, y, valid, x) and the aggregations over them."""

    def __init__(self, rows: DataFrame, weights: np.ndarray, settings: Settings):
        self.rows, self.weights, self.settings = rows, weights, settings
        self.parts = max(1, rows.rdd.getNumPartitions())

    def _sums(self, size: int, of_batch) -> np.ndarray:
        """`of_batch` (keys, y, valid, inputs) gives `size` sums; they are added up in the order of the tasks."""
        return summed(self.rows, self.parts, size, of_batch)

    def gradient(self, parameters: Parameters, epoch: int, step: int) -> tuple[float, np.ndarray]:
        """Weighted mean loss of a step's rows and its gradient."""
        weights, settings, sizes = self.weights, self.settings, parameters.sizes

        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            keys, y, valid, x = _columns(batch, sizes[0])
            chosen = ~valid & of_step(keys, epoch, step, settings)
            keys, y, x = keys[chosen], y[chosen], x[chosen]
            masks = drop_masks(keys, epoch * settings.steps + step, sizes[1:-1], settings)
            return np.concatenate([[weights[y].sum()], *map(np.atleast_1d, gradient(parameters, x, y, weights, settings.smoothing, masks))])

        sums = self._sums(2 + len(parameters.values), of_batch)
        if not sums[0]:
            return 0.0, np.zeros(len(parameters.values))
        return sums[1] / sums[0], sums[2:] / sums[0]

    def metrics(self, parameters: Parameters) -> list[tuple]:
        """Rows, weighted mean loss and accuracy of the training and of the validation rows."""
        weights, smoothing, sizes = self.weights, self.settings.smoothing, parameters.sizes
        layers = parameters.layers()

        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            _, y, valid, x = _columns(batch, sizes[0])
            p = forward(layers, x)[-1]
            loss, hit = losses(p, y, weights, smoothing)[0], p.argmax(axis=1) == y
            return np.array([v[side].sum() for side in (~valid, valid) for v in (np.ones(len(y)), weights[y], loss, hit)])

        sums = self._sums(8, of_batch).reshape(2, 4)
        return [(int(n), float(loss / w) if n else None, float(hit / n) if n else None) for n, w, loss, hit in sums]


def _columns(batch: pa.RecordBatch, width: int):
    y = batch.column(1).to_numpy().astype(np.int64)
    return batch.column(0).to_numpy(), y, batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3), width)


def _prepared(training, validation, key, labels: Dictionary, vector, label, settings) -> DataFrame:
    """Rows of both tables in partitions of bounded size; unknown labels drop out."""

    def side(rows: DataFrame, valid: bool) -> DataFrame:
        known = labels.encode(rows.filter(F.col(label).isNotNull()), label, "_y")
        return known.select(F.xxhash64(key).alias("key"), F.col("_y").alias("y"), F.lit(valid).alias("valid"), _floats(F.col(vector), settings).alias("x"))

    both = side(training, False)
    if validation is not None:
        both = both.unionByName(side(validation, True))
    first = _written(both)
    parts = max(1, -(-first.count() // ROWS_PER_TASK))
    return _written(first.repartition(parts, "key").sortWithinPartitions("key"))


def _written(rows: DataFrame) -> DataFrame:
    path = scratch_path(rows.sparkSession, "network")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _begin(training, validation, key, vector, label, settings) -> tuple[list, list, _Rows]:
    known = training.filter(F.col(label).isNotNull())
    labels = Dictionary.fit(known, label)
    weighted = class_weights(known, label, labels).orderBy("index").collect()
    if len(weighted) < 2:
        raise ValueError("training needs at least two classes")
    weights = [float(r["weight"]) if settings.balanced else 1.0 for r in weighted]
    rows = _prepared(training, validation, key, labels, vector, label, settings)
    return [r[label] for r in weighted], weights, _Rows(rows, np.array(weights), settings)


def fit(
    training: DataFrame,
    validation: DataFrame | None = None,
    key: str = "ID",
    vector: str = "inputs",
    label: str = LABEL,
    settings: Settings = Settings(),
    start: Network | None = None,
    until: int | None = None,
) -> Network:
    """Fit a network on arrays of inputs; rows are weighted by rows / (classes * class count).

    `key` identifies a row. The epoch with the best accuracy on the validation rows (else on the training
    rows) is kept, the first one on ties. `until` ends a fit early, and `start` takes one up where it ended.
    Null and NaN inputs are zeros, rows without a known label drop out, one class or rows of unlike
    lengths are errors.
    """
    labels, weights, rows = _begin(training, validation, key, vector, label, settings)
    if start is None:
        width = rows.rows.select(F.size("x")).first()[0]
        first = Parameters.first([width, *settings.hidden, len(labels)], settings.seed)
        start = Network(labels, weights, settings, first, first, np.zeros((2, len(first.values))))
    elif start.labels != labels or start.settings != settings:
        raise ValueError("the fit to go on with has other labels or settings")
    if start.last.values.nbytes > MODEL_BYTES:
        raise ValueError(f"the network takes more than {MODEL_BYTES} bytes, which is what tasks are sent at most")
    net = Network(labels, weights, settings, start.best, start.last, start.momenta.copy(), list(start.history), start.chosen)
    best = max((_judged(h) for h in net.history), default=-1.0)
    for epoch in range(len(net.history), settings.epochs if until is None else min(until, settings.epochs)):
        values = net.last.values.copy()
        for step in range(settings.steps):
            _, slope = rows.gradient(Parameters(net.last.sizes, values), epoch, step)
            values = moved(values, slope, net.momenta, epoch * settings.steps + step + 1, rate(settings, epoch), settings)
        net.last = Parameters(net.last.sizes, values)
        train, valid = rows.metrics(net.last)
        net.history.append((epoch + 1, *train, *valid))
        if _judged(net.history[-1]) > best:
            best, net.best, net.chosen = _judged(net.history[-1]), net.last, epoch + 1
    return net


def _judged(metrics: tuple) -> float:
    return metrics[6] if metrics[4] else metrics[3]


def moved(values, slope, momenta, number: int, rate: float, settings: Settings) -> np.ndarray:
    """The parameters after a step along a clipped gradient; the momenta are updated in place."""
    slope = slope * min(1.0, settings.clip / max(float(np.linalg.norm(slope)), 1e-12))
    momenta[0] += (1 - BETA_1) * (slope - momenta[0])
    momenta[1] += (1 - BETA_2) * (slope**2 - momenta[1])
    mean, square = momenta[0] / (1 - BETA_1**number), momenta[1] / (1 - BETA_2**number)
    return values - rate * (mean / (np.sqrt(square) + EPSILON) + settings.decay * values)


def first_gradient(training: DataFrame, names: Sequence[str], key: str = "ID", vector: str = "inputs", label: str = LABEL, settings: Settings = Settings()) -> DataFrame:
    """label, input and slope of the first step over all rows for a network without hidden layers; input `(bias)` is the bias."""
    labels, _, rows = _begin(training, None, key, vector, label, settings)
    start = Parameters.first([len(names), len(labels)], settings.seed)
    _, slope = rows.gradient(start, 0, 0)
    shaped = slope.reshape(len(names) + 1, len(labels))
    found = [(y, x, float(shaped[i, k])) for i, x in enumerate([*names, "(bias)"]) for k, y in enumerate(labels)]
    return training.sparkSession.createDataFrame(found, "label string, input string, slope double")
