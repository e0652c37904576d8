"""Spark ML's perceptron, with gradients that tasks compute by matrix products over many rows.

Starting weights, loss, solver (L-BFGS), parameters and the fitted model are those of
`MultilayerPerceptronClassifier`, so a fit follows the same path but for the last digits of its sums, which a
hundred rounds may carry into the third digit of the loss, as other partitions do there. Small tables are
left to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from flowlens.operators.boosting import FEWEST_ROWS
from flowlens.operators.network import MODEL_BYTES, Parameters, summed

#: Pairs of steps and gradient changes that L-BFGS keeps, and trials of a search along a direction, as in Spark ML.
KEPT, TRIALS = 10, 10
#: Conditions on a step: the loss falls by this share of its slope, and the slope falls to this share.
FALL, FLATTER = 1e-4, 0.9
#: Rounds that the loss is compared with, as in Spark ML.
LOOK_BACK = 20
#: Rows whose activations are held together, and bytes of their inputs.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
CODEC = "lz4_raw"
#: Rows times weights up to which Spark ML's own tasks end a round sooner than Python tasks, which take longer to start.
SHORT_ROUND = 2_000_000_000
#: Most rows that a task walks through in a round.
TASK_ROWS = 500_000


class SearchFailed(ArithmeticError):
    """No step along a direction meets the conditions."""


def minimized(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, tolerance: float
) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with strong Wolfe conditions: the last point and the losses by round, the first point's included."""
    x, (value, slope) = start, loss(start)
    losses, kept, failed = [value], [], False
    while len(losses) <= rounds and not _settled(losses, slope, tolerance):
        try:
            way = _direction(kept, slope)
            first = 1.0 if len(losses) > 1 else 1.0 / np.linalg.norm(way)
            step, value, moved = _search(lambda t: loss(x + t * way), way, value, slope, first)
            if step * np.linalg.norm(slope) < 1e-10:
                raise SearchFailed("the step is too small")
        except SearchFailed:
            if failed:
                break
            # The kept steps may mislead; try once along the gradient.
            kept, failed, value = [], True, losses[-1]
            continue
        # Last steps first.
        kept = [(x + step * way - x, moved - slope), *kept][:KEPT]
        x, slope, failed = x + step * way, moved, False
        losses.append(value)
    return x, losses


def _settled(losses: list[float], slope: np.ndarray, tolerance: float) -> bool:
    """The loss has not moved for some rounds, or the gradient is next to nothing."""
    still = len(losses) > LOOK_BACK and abs(losses[-1] - max(losses[-LOOK_BACK:])) <= tolerance * abs(losses[0])
    return still or np.linalg.norm(slope) <= max(tolerance * abs(losses[-1]), 1e-8)


def _direction(kept: Sequence[tuple[np.ndarray, np.ndarray]], slope: np.ndarray) -> np.ndarray:
    """The way down by the gradient and the curvature along the last steps."""
    way, shares = slope.copy(), []
    for step, change in kept:
        shares.append(step @ way / (step @ change))
        way -= shares[-1] * change
    if kept:
        step, change = kept[0]
        if not step @ change >= 0 or not np.isfinite(shares).all():
            raise SearchFailed("the last steps give no curvature")
        way *= step @ change / (change @ change)
    for (step, change), share in zip(reversed(kept), reversed(shares)):
        way += (share - change @ way / (step @ change)) * step
    return -way


def _search(along: Callable[[float], tuple[float, np.ndarray]], way: np.ndarray, value: float, slope: np.ndarray, t: float):
    """A step that meets the conditions, tried from `t` on, with loss and gradient there."""
    steepness = float(slope @ way)
    if steepness > 0:
        raise SearchFailed("the direction leads up")

    def at(t: float):
        found, gradient = along(t)
        return t, found, float(gradient @ way), gradient

    def high(point) -> bool:
        return point[1] > value + FALL * point[0] * steepness

    def between(low, far):
        for _ in range(TRIALS):
            point = at(_cubic(*sorted((low, far), key=lambda p: p[0])))
            if high(point) or point[1] >= low[1]:
                far = point
                continue
            if abs(point[2]) <= FLATTER * abs(steepness):
                return point
            if point[2] * (far[0] - low[0]) >= 0:
                far = low
            low = point
        raise SearchFailed("no step between two points")

    low = (0.0, value, steepness, slope)
    for trial in range(TRIALS):
        point = at(t)
        if not math.isfinite(point[1]):
            t /= 2
            continue
        if high(point) or (trial and point[1] >= low[1]):
            point = between(low, point)
        elif abs(point[2]) > FLATTER * abs(steepness):
            if point[2] < 0:
                low, t = point, t * 1.5
                continue
            point = between(point, low)
        return point[0], point[1], point[3]
    raise SearchFailed("no step is long enough")


def _cubic(left, right) -> float:
    """The lowest point of the cubic through two points and their slopes, kept off both."""
    (a, fa, da, _), (b, fb, db, _) = left, right
    bend = da + db - 3 * (fa - fb) / (a - b)
    inner = bend * bend - da * db
    root = math.sqrt(inner) if inner >= 0 else math.nan
    below = db - da + 2 * root
    t = b - (b - a) * (db + root - bend) / below if below else math.nan
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if t < low else high if t > high else t


def gradient(parameters: Parameters, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted sum of the rows' cross entropy and its gradient; hidden layers are logistic."""
    layers = parameters.layers()
    held = [x]
    for i, (weights, bias) in enumerate(layers):
        z = held[-1] @ weights
        z += bias
        if i < len(layers) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
        held.append(z)
    z -= z.max(axis=1, keepdims=True)
    mine = np.arange(len(y)), y
    d = np.exp(z)
    total = d.sum(axis=1)
    loss = w @ (np.log(total) - z[mine])
    d /= total[:, None]
    d[mine] -= 1.0
    d *= w[:, None]
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(held[i].T @ d).ravel(), d.sum(axis=0), *parts]
        if i:
            d = d @ layers[i][0].T
            d *= held[i]
            d *= 1.0 - held[i]
    return float(loss), np.concatenate(parts)


class PerceptronClassifier(MultilayerPerceptronClassifier):
    """Spark ML's perceptron, fitted by matrix products in Python tasks where rounds are long.

    The fitted model's `losses` are those by round. After a fit in Python tasks its summary knows no round.
    """

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        sizes = self.getLayers()
        model = self._model(dataset, None)
        start = model.weights.toArray()
        if start.nbytes > MODEL_BYTES:
            raise ValueError(f"the network takes more than {MODEL_BYTES} bytes, which is what tasks are sent at most")
        asked = dataset.select(F.col(self.getLabelCol()).cast("double").alias("y"), vector_to_array(self.getFeaturesCol()).alias("x"))
        size, stack = asked.count(), self.getBlockSize()
        if size * len(start) <= SHORT_ROUND:
            model = super()._fit(dataset)
            model.losses = list(model.summary().objectiveHistory)
            return model
        parts = tasks(size, dataset.sparkSession.sparkContext.defaultParallelism)
        held = blocks(asked, sizes[0], sizes[-1], stack).repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)

        def loss(values: np.ndarray) -> tuple[float, np.ndarray]:
            parameters = Parameters(list(sizes), values)

            def of_batch(batch: pa.RecordBatch) -> np.ndarray:
                total = np.zeros(2 + len(values))
                for y, x in zip(batch.column(0), batch.column(1)):
                    y = np.frombuffer(y.as_buffer(), np.int32)
                    x = pa.decompress(x.as_buffer(), 8 * len(y) * sizes[0], CODEC)
                    shares = _shares(len(y), stack)
                    found, slope = gradient(parameters, np.frombuffer(x, np.float64).reshape(len(y), sizes[0]), y, shares)
                    total[0] += shares.sum()
                    total[1] += found
                    total[2:] += slope
                return total

            sums = summed(held, parts, 2 + len(values), of_batch)
            return (sums[1] / sums[0], sums[2:] / sums[0]) if sums[0] else (math.nan, sums[2:])

        try:
            weights, losses = minimized(loss, start, self.getMaxIter(), self.getTol())
        finally:
            held.unpersist()
        model = self._model(dataset, weights)
        model.losses = losses
        return model

    def _model(self, dataset: DataFrame, weights: np.ndarray | None) -> MultilayerPerceptronClassificationModel:
        """Spark ML's model with these weights, else with its first ones: a fit of no rounds."""
        asked = {p.name: v for p, v in self.extractParamMap().items()}
        if weights is not None:
            asked["initialWeights"] = Vectors.dense(weights)
        plain = MultilayerPerceptronClassifier(**{**asked, "maxIter": 0})
        # One row of zeros stands in for the rows that no round reads.
        row = (0.0, Vectors.dense(np.zeros(self.getLayers()[0])))
        model = plain.fit(dataset.sparkSession.createDataFrame([row], [self.getLabelCol(), self.getFeaturesCol()]))
        model._set(maxIter=self.getMaxIter())
        if weights is not None and not self.isDefined("initialWeights"):
            model.clear(model.initialWeights)
            model._java_obj.clear(model._java_obj.getParam("initialWeights"))
        return model


def tasks(rows: int, cores: int) -> int:
    """One for each core, some for each where there are many rows, so that no core waits; fewer for few rows."""
    each = -(-rows // (cores * TASK_ROWS))
    return cores * each if each > 1 else max(1, min(cores, rows // FEWEST_ROWS))


def _shares(rows: int, stack: int) -> np.ndarray:
    """The share of each row of a block in its stack of `stack` rows; the last stack may have fewer."""
    whole = rows // stack * stack
    return np.where(np.arange(rows) < whole, 1.0 / stack, 1.0 / max(rows - whole, 1))


def blocks(rows: DataFrame, width: int, classes: int, stack: int) -> DataFrame:
    """Labels and inputs of consecutive rows as bytes, the inputs compressed without loss.

    `stack` rows of a partition, at its end fewer, make a stack, and blocks hold whole stacks. The loss is the mean
    over the stacks of their rows' means, as in Spark ML, so blocks may go to any task.
    """
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)) // stack) * stack

    def block(table: pa.Table) -> pa.RecordBatch:
        y = table.column(0).combine_chunks().to_numpy(zero_copy_only=False)
        fine = (y >= 0) & (y < classes) & (y == np.floor(y))
        if not fine.all():
            raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}, not {y[~fine][0]}")
        lists = table.column(1).combine_chunks()
        x = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False))
        if lists.null_count or len(x) != len(y) * width or not np.isfinite(x).all():
            raise ValueError(f"every row needs {width} finite inputs")
        made = [y.astype(np.int32).tobytes(), pa.compress(pa.py_buffer(x), CODEC, asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in made], names=["y", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held else table
            whole = held.num_rows // size * size
            for at in range(0, whole, size):
                yield block(held.slice(at, size))
            held = held.slice(whole)
        if held:
            yield block(held)

    return rows.mapInArrow(run, "y binary, x binary")
