"""Model queries fit what the operators' defaults say."""

import pytest

from flowlens.operators import models
from flowlens.plans import learning


class Stopped(Exception):
    """Carries the classifier a query was about to fit."""


def _asked_for(monkeypatch, query, spark, sf):
    def stop(rows, classifier, **_):
        raise Stopped(classifier)

    monkeypatch.setattr(learning.models, "train", stop)
    monkeypatch.setattr(learning.models, "train_vectors", stop)
    with pytest.raises(Stopped) as stopped:
        query(spark, sf)
    return stopped.value.args[0]


def _values(classifier):
    return {p.name: v for p, v in classifier.extractParamMap().items() if p.name != "classifier"}


@pytest.mark.parametrize(
    "query, expected",
    [
        (learning.model_rf, lambda: models.random_forest()),
        (learning.model_rf_hist, lambda: models.histogram_forest()),
    ],
)
def test_tree_queries_fit_the_defaults(query, expected, monkeypatch, spark, sf):
    got, want = _asked_for(monkeypatch, query, spark, sf), expected()
    assert _values(got) == _values(want)
    if hasattr(want, "getClassifier"):
        assert _values(got.getClassifier()) == _values(want.getClassifier())


@pytest.mark.parametrize("query", [learning.model_mlp, learning.score_requests])
def test_network_queries_fit_the_defaults(query, monkeypatch, spark, sf):
    network = _asked_for(monkeypatch, query, spark, sf)
    width, *hidden, classes = network.getLayers()
    want = models.perceptron(width, classes)
    assert network.getLayers() == want.getLayers() and network.getMaxIter() == want.getMaxIter()
