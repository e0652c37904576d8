"""The perceptron whose gradients come from matrix products in tasks, against Spark ML's own."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from flowlens.operators import models, network, perceptron
from flowlens.operators.network import Parameters
from flowlens.operators.perceptron import PerceptronClassifier


@pytest.fixture
def rows(spark):
    held = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 6))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(int) + (x[:, 2] > 0.7) + (rng.random(700) < 0.1)
    made = [(float(k), Vectors.dense(v)) for k, v in zip(y, x)]
    # Three partitions whose last stacks are not full.
    return spark.createDataFrame(spark.sparkContext.parallelize(made, 3), held)


@pytest.mark.parametrize("hidden", [(), (8,), (8, 5)])
def test_gradient_matches_differences(hidden):
    rng = np.random.default_rng(1)
    sizes = [5, *hidden, 3]
    values = rng.standard_normal(sum((n + 1) * m for n, m in zip(sizes, sizes[1:])))
    x, y, w = rng.standard_normal((9, 5)), rng.integers(0, 3, 9), rng.random(9)
    _, slope = perceptron.gradient(Parameters(sizes, values), x, y, w)
    for i in range(len(values)):
        step = np.zeros(len(values))
        step[i] = 1e-6
        high, low = (perceptron.gradient(Parameters(sizes, values + s), x, y, w)[0] for s in (step, -step))
        assert abs((high - low) / 2e-6 - slope[i]) < 1e-6


def test_solver_finds_the_valley():
    def valley(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    x, losses = perceptron.minimized(valley, np.array([-1.2, 1.0]), 100, 1e-12)
    assert np.allclose(x, 1.0, atol=1e-4) and losses[-1] < 1e-8 < losses[0]


def test_solver_ends_where_no_step_helps():
    x, losses = perceptron.minimized(lambda x: (float("nan"), np.ones(2)), np.zeros(2), 100, 1e-6)
    assert x.tolist() == [0.0, 0.0] and len(losses) == 1


@pytest.fixture
def in_tasks(monkeypatch):
    """No round is too short for Python tasks."""
    monkeypatch.setattr(perceptron, "SHORT_ROUND", 0)


@pytest.mark.parametrize("stack", [128, 50])
def test_fit_follows_spark_ml(in_tasks, rows, stack):
    asked = dict(layers=[6, 8, 4], maxIter=40, seed=7, blockSize=stack)
    ours = PerceptronClassifier(**asked).fit(rows)
    theirs = MultilayerPerceptronClassifier(**asked).fit(rows)
    assert np.allclose(ours.losses, list(theirs.summary().objectiveHistory), rtol=1e-8)
    assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), rtol=1e-4, atol=1e-6)
    assert ours.transform(rows).select("prediction").collect() == theirs.transform(rows).select("prediction").collect()


def test_small_tables_are_left_to_spark_ml(rows):
    asked = dict(layers=[6, 8, 4], maxIter=10, seed=7)
    ours, theirs = PerceptronClassifier(**asked).fit(rows), MultilayerPerceptronClassifier(**asked).fit(rows)
    assert ours.losses == pytest.approx(list(theirs.summary().objectiveHistory), rel=1e-12)
    assert ours.summary().totalIterations == theirs.summary().totalIterations


def test_blocks_keep_every_row(rows, monkeypatch):
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 100)
    found = perceptron.blocks(rows.select("label", perceptron.vector_to_array("features")), 6, 4, 50).collect()
    assert max(len(r["y"]) // 4 for r in found) == 100
    inputs = [np.frombuffer(pa.decompress(r["x"], 12 * len(r["y"]), perceptron.CODEC)).reshape(-1, 6) for r in found]
    assert np.array_equal(np.concatenate(inputs), np.array([r["features"].toArray() for r in rows.collect()]))


def test_partial_sums_are_merged_in_tasks_where_many(in_tasks, rows, monkeypatch):
    asked = dict(layers=[6, 8, 4], maxIter=3, seed=7, blockSize=10)
    monkeypatch.setattr(perceptron, "tasks", lambda *_: 5)
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 10)
    whole = PerceptronClassifier(**asked).fit(rows)
    monkeypatch.setattr(network, "DRIVER_BYTES", 0)
    assert PerceptronClassifier(**asked).fit(rows).weights == whole.weights


def test_tasks_fill_all_cores():
    assert [perceptron.tasks(n, 12) for n in (1, 5_000_000, 6_000_001)] == [1, 12, 24]


def test_model_is_stored_with_its_parameters(in_tasks, rows, tmp_path):
    model = models.perceptron(6, 4, hidden=(8,), rounds=5).fit(rows)
    model.write().save(str(tmp_path / "model"))
    loaded = MultilayerPerceptronClassificationModel.load(str(tmp_path / "model"))
    assert loaded.getMaxIter() == 5 and not loaded.isDefined("initialWeights")
    assert loaded.weights == model.weights and len(model.losses) == 6


def test_unfit_rows_are_errors(in_tasks, rows):
    with pytest.raises(Exception, match="labels must be"):
        PerceptronClassifier(layers=[6, 3], maxIter=2).fit(rows)
    with pytest.raises(Exception, match="finite inputs"):
        PerceptronClassifier(layers=[7, 4], maxIter=2).fit(rows)
    empty = PerceptronClassifier(layers=[6, 4], maxIter=2, seed=1).fit(rows.limit(0))
    assert len(empty.weights) == 28
