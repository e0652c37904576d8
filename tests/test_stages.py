"""Forests as Spark ML stages whose trees stay in a table."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, functions as F

from flowlens.operators import forest as G, models, scoring, stages

FEATURES = ["a", "b", "c"]


def _rows(spark, n, seed):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = float(pick.randint(0, 9)), pick.random() * 4
        name = "z" if pick.random() < 0.1 else "x" if a + pick.gauss(0, 1) < 5 else "y"
        rows.append((i, a, b, pick.random() + (name == "z") * 0.8, name))
    return spark.createDataFrame(rows, "ID long, a double, b double, c double, APP string")


def _scored(model, rows):
    return {r["ID"]: (r["y_pred"], r["probability"].toArray()) for r in models.scorer(model).transform(rows).collect()}


def test_default_forests_keep_their_trees_in_a_table(spark, monkeypatch):
    """Neither fitting nor scoring brings a tree to the driver; groups and parts sum to a plain walk of all trees."""
    monkeypatch.setattr(G, "GROUP_BYTES", 1000)
    monkeypatch.setattr(G, "ROWS_PER_TASK", 70)
    monkeypatch.setattr(G, "_grown_whole", None)
    rows = _rows(spark, 300, 1)
    for classifier, balanced in ((models.random_forest(trees=9, min_rows=3), True), (models.histogram_forest(trees=9), False)):
        model = models.train(rows, classifier, FEATURES, balanced=balanced)
        kept = model.stages[2]
        assert isinstance(kept.trees, DataFrame) and kept.trees.count() == 9
        held = rows.orderBy("ID").collect()
        x = np.array([[r[f] for f in FEATURES] for r in held])
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(kept.cuts)], axis=1)
        trees = [G._tree(r["feature"], r["cut"], r["child"], r["counts"], 3) for r in kept.trees.collect()]
        want = sum(t.shares(kept.weights)[t.places(bins)] for t in trees) / 9
        got = _scored(model, rows)
        assert len(got) == 300 and max(len(t.feature) for t in trees) > 7
        for i, p in enumerate(want):
            assert np.allclose(got[i][1], p) and got[i][0] == "xyz"[p.round(12).argmax()]


def test_weights_are_balanced_over_the_table(spark):
    rows = _rows(spark, 300, 2)
    kept = models.train(rows, models.random_forest(trees=2), FEATURES, balanced=True).stages[2]
    counts = {r["APP"]: r["count"] for r in rows.groupBy("APP").count().collect()}
    assert np.allclose(kept.weights, [300 / (3 * counts[n]) for n in "xyz"])


def test_accuracy_is_that_of_the_library(spark):
    train, valid = _rows(spark, 1500, 3), _rows(spark, 1500, 4)
    setting = dict(numTrees=60, minInstancesPerNode=10, maxDepth=30, maxBins=32, featureSubsetStrategy="sqrt", seed=5)
    found = []
    for kind in (stages.ForestClassifier, RandomForestClassifier):
        model = models.train(train, kind(**setting), FEATURES, balanced=True)
        found.append((scoring.evaluate(model, valid)[0].first(), models.feature_importance(model, FEATURES)))
    (ours, mine), (theirs, other) = found
    assert abs(ours["accuracy"] - theirs["accuracy"]) < 0.03 and abs(ours["macro_f1"] - theirs["macro_f1"]) < 0.04
    mine, other = ({r["feature"]: r["importance"] for r in t.collect()} for t in (mine, other))
    assert abs(sum(mine.values()) - 1) < 1e-9 and all(abs(mine[f] - other[f]) < 0.06 for f in FEATURES)


def test_large_tables_give_the_same_trees(spark, monkeypatch):
    rows = _rows(spark, 200, 6).coalesce(1)
    classifier = models.random_forest(trees=4, min_rows=3)
    whole = _scored(models.train(rows, classifier, FEATURES), rows)
    monkeypatch.setattr(G, "TREE_ROWS", 0)
    merged = _scored(models.train(rows, classifier, FEATURES), rows)
    assert all(a == merged[i][0] and np.allclose(p, merged[i][1]) for i, (a, p) in whole.items())


def test_stored_models_score_alike(spark, tmp_path):
    rows = _rows(spark, 200, 7)
    model = models.train(rows, models.random_forest(trees=5, min_rows=3), FEATURES)
    models.save(model, str(tmp_path / "model"))
    again, first = _scored(models.load(str(tmp_path / "model")), rows), _scored(model, rows)
    assert all(a == again[i][0] and np.allclose(p, again[i][1]) for i, (a, p) in first.items())
    assert scoring.score(model, rows.limit(0), ["ID"]).count() == 0


def test_what_is_not_supported_is_an_error(spark):
    rows = _rows(spark, 60, 8)
    for wrong in (models.random_forest(trees=2).setImpurity("entropy"), models.random_forest(trees=2, bins=300)):
        with pytest.raises(ValueError):
            models.train(rows, wrong, FEATURES)
    with pytest.raises(ValueError):
        models.train(rows.withColumn("w", F.col("b")), models.random_forest(trees=2).setWeightCol("w"), FEATURES)


def test_cuts_lie_between_few_values_and_at_quantiles_of_many(spark):
    rows = spark.createDataFrame([([float(i % 3 == 0), float(i), float("nan")],) for i in range(1000)], "x array<double>")
    few, many, none = stages.cuts_of(rows, 3, 8)
    assert few.tolist() == [0.5] and len(many) == 7 and abs(many[3] - 500) < 5 and len(none) == 0
