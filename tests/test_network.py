"""The weighted network: gradients against differences, the fit against a plain one, weights and going on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics, models, network as N

SMALL = N.Settings(epochs=3, steps=2, hidden=(5,), warmup=1)


def _rows(spark, n, seed, rare=0.05, width=4):
    """Two classes that overlap, one of them rare."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        name = "rare" if pick.random() < rare else "common"
        middle = 0.9 if name == "rare" else -0.4
        rows.append((i, [pick.gauss(middle, 1.0) for _ in range(width)], name))
    return spark.createDataFrame(rows, "ID long, inputs array<double>, APP string")


@pytest.mark.parametrize("hidden", [(), (5,), (4, 3)])
def test_gradient_equals_differences(hidden):
    rng = np.random.default_rng(3)
    x, y, weights = rng.normal(size=(20, 6)), rng.integers(0, 3, 20), np.array([0.5, 2.0, 1.2])
    start = N.Parameters.first([6, *hidden, 3], 7)
    start.values += rng.normal(size=len(start.values)) * 0.3
    masks = N.drop_masks(np.arange(20), 4, hidden, N.Settings()) if hidden else None
    _, slope = N.gradient(start, x, y, weights, 0.05, masks)
    for i in range(len(start.values)):
        ends = []
        for d in (1e-6, -1e-6):
            values = start.values.copy()
            values[i] += d
            ends.append(N.gradient(N.Parameters(start.sizes, values), x, y, weights, 0.05, masks)[0])
        assert abs((ends[0] - ends[1]) / 2e-6 - slope[i]) < 1e-4


def _plain(rows, settings, weights):
    """The fit on all rows at once, with the steps and masks of the same keys."""
    x = np.array([r["inputs"] for r in rows], np.float32).astype(float)
    names = sorted({r["APP"] for r in rows})
    y, keys = np.array([names.index(r["APP"]) for r in rows]), np.array([r["key"] for r in rows], np.int64)
    net = N.Parameters.first([x.shape[1], *settings.hidden, len(names)], settings.seed)
    momenta, number = np.zeros((2, len(net.values))), 0
    for epoch in range(settings.epochs):
        for step in range(settings.steps):
            at = N.of_step(keys, epoch, step, settings)
            masks = N.drop_masks(keys[at], number, settings.hidden, settings)
            _, slope = N.gradient(net, x[at], y[at], weights, settings.smoothing, masks)
            number += 1
            net.values = N.moved(net.values, slope / weights[y[at]].sum(), momenta, number, N.rate(settings, epoch), settings)
    return net.values


@pytest.mark.parametrize("parts", [1, 3])
def test_equals_plain_fit(spark, monkeypatch, parts):
    monkeypatch.setattr(N, "ROWS_PER_TASK", 300 // parts)
    monkeypatch.setattr(N, "MERGE_BYTES", 1)
    monkeypatch.setattr(N, "SLICE", 64)
    rows = _rows(spark, 300, 1)
    net = N.fit(rows, settings=SMALL)
    held = rows.withColumn("key", F.xxhash64("ID")).collect()
    counts = np.array([sum(r["APP"] == c for r in held) for c in ("common", "rare")])
    assert net.labels == ["common", "rare"] and np.allclose(net.weights, 300 / (2 * counts))
    assert np.allclose(net.last.values, _plain(held, SMALL, np.array(net.weights)), atol=1e-9)


def test_steps_of_an_epoch_share_all_rows():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 4000)
    dealt = np.stack([N.of_step(keys, 5, s, SMALL) for s in range(2)])
    assert (dealt.sum(axis=0) == 1).all() and 0.4 < dealt[0].mean() < 0.6
    kept = N.drop_masks(keys, 9, (5,), SMALL)[0] > 0
    assert abs(kept.mean() - 0.7) < 0.02 and abs(np.corrcoef(kept.T)[0, 1]) < 0.06


def test_weights_raise_the_recall_of_the_rare_class(spark):
    train, valid = _rows(spark, 1500, 2), _rows(spark, 700, 3)
    settings = N.Settings(epochs=10, hidden=(16,), steps=2, rate=0.03)
    net = N.fit(train, valid, settings=settings)
    epochs = net.epochs().orderBy("epoch").collect()
    assert [e.train_rows for e in epochs] == [1500] * 10 and epochs[-1].train_loss < epochs[0].train_loss
    accuracy = [e.valid_accuracy for e in epochs]
    assert [e.epoch for e in epochs if e.chosen] == [1 + accuracy.index(max(accuracy))]

    def recall(scored):
        report = metrics.class_report(scored.select(F.col("APP").alias("y_true"), "y_pred"))
        return report.filter("label = 'rare'").first()["recall"]

    plain = models.train_vectors(train, models.perceptron(4, 2, hidden=(16,)))
    unweighted = models.scorer(plain).transform(models.as_vectors(valid))
    last = N.Network(net.labels, net.weights, settings, net.last, net.last, net.momenta)
    assert recall(last.score(valid, ["APP"])) > recall(unweighted) + 0.2
    # The metrics of the chosen epoch are those of its scores.
    scored = net.score(valid, ["APP"]).collect()
    assert sum(r.APP == r.y_pred for r in scored) / 700 == pytest.approx(max(accuracy))
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in scored)


def test_goes_on_where_it_ended(spark, tmp_path):
    rows, valid = _rows(spark, 200, 4), _rows(spark, 80, 5)
    whole = N.fit(rows, valid, settings=SMALL)
    N.fit(rows, valid, settings=SMALL, until=1).save(str(tmp_path / "net"))
    part = N.Network.load(spark, str(tmp_path / "net"), SMALL)
    assert len(part.history) == 1
    rest = N.fit(rows, valid, settings=SMALL, start=part)
    assert np.allclose(rest.last.values, whole.last.values) and rest.history == whole.history and rest.chosen == whole.chosen
    with pytest.raises(ValueError):
        N.Network.load(spark, str(tmp_path / "net"), N.Settings())
    with pytest.raises(ValueError):
        N.fit(rows.withColumn("APP", F.concat("APP", F.lit("2"))), settings=SMALL, start=part)


def test_sequence_only_looks_at_no_other_input(spark):
    settings = N.Settings(epochs=2, steps=1, hidden=(3,), sequence_only=True)
    rows = _rows(spark, 60, 6, rare=0.3, width=N.SEQUENCE_INPUTS + 5)
    net = N.fit(rows, settings=settings)
    blank = rows.withColumn("inputs", F.transform("inputs", lambda x, i: F.when(i < N.SEQUENCE_INPUTS, x).otherwise(F.lit(9.0))))
    a, b = (net.score(t, ["ID"]).orderBy("ID").collect() for t in (rows, blank))
    assert a == b


def test_odd_rows(spark):
    """Null and NaN inputs are zeros; unlabelled rows drop out; one class, no rows and short rows are errors."""
    rows = _rows(spark, 80, 7, rare=0.4)
    odd = rows.withColumn("inputs", F.transform("inputs", lambda x, i: F.when(i == 0, F.lit(None)).when(i == 1, F.lit(float("nan"))).otherwise(x)))
    net = N.fit(odd.withColumn("APP", F.when(F.col("ID") > 5, F.col("APP"))), settings=SMALL)
    assert net.history[0][1] == 74 and net.score(odd, ["ID"]).count() == 80 and net.score(odd.limit(0), ["ID"]).count() == 0
    for wrong in (rows.withColumn("APP", F.lit("x")), rows.limit(0), rows.withColumn("inputs", F.slice("inputs", 1, (F.col("ID") % 2 + 1).cast("int")))):
        with pytest.raises(Exception):
            N.fit(wrong, settings=SMALL)
