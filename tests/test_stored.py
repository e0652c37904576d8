"""What is stored between runs: statistics per file, cached features and model bundles."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import models, sequences, stats
from flowlens.operators.encode import Dictionary
from flowlens.plans import views as v
from flowlens.sources.cache import FeatureCache


@pytest.fixture(scope="module")
def samples(spark, sf):
    flows = v.flows(spark, sf)
    labels, versions = Dictionary.fit(flows, "APP"), Dictionary.fit(flows, "QUIC_VERSION", first=1)
    return sequences.samples(flows, labels, versions, keep=["ID", "day"]).cache()


def _close(a, b):
    for left, right in ((a.seq_mean, b.seq_mean), (a.seq_std, b.seq_std), (a.tab_mean, b.tab_mean), (a.tab_std, b.tab_std)):
        assert left == pytest.approx(right, rel=1e-9, abs=1e-9)


def test_statistics_of_files_are_merged(spark, samples, tmp_path):
    held = stats.FileStatistics(spark, str(tmp_path / "sums"), sequences.TABULAR_WIDTH)
    early = F.dayofmonth("day") < 12
    held.add(samples.filter(early), "day")
    _close(held.normalization(), stats.Normalization.fit(samples.filter(early), sequences.TABULAR_WIDTH))
    days = held.files().count()
    # Later days and one day that comes again: it replaces its row, the other rows are left as they are.
    again = F.dayofmonth("day") == 5
    held.add(samples.filter(~early | again), "day")
    _close(held.normalization(), stats.Normalization.fit(samples, sequences.TABULAR_WIDTH))
    assert held.files().count() == samples.select("day").distinct().count() > days


def test_feature_cache(spark, tmp_path):
    source = str(tmp_path / "day")
    spark.range(5).selectExpr("id", "id * 2 AS x").write.parquet(source)
    cache = FeatureCache(spark, str(tmp_path / "cache"))
    built = []

    def build(path):
        built.append(path)
        return spark.read.parquet(path).selectExpr("id", "x + 1 AS y")

    first, hit = cache.get(source, ["y"], build)
    assert not hit and first.agg(F.sum("y")).first()[0] == 25

    def forbidden(path):
        raise AssertionError("a hit reads no source file")

    table, hit = cache.get(source, ["y"], forbidden)
    assert hit and table.count() == 5 and len(built) == 1
    assert not cache.get(source, ["y", "z"], build)[1]
    spark.range(2).selectExpr("id", "id AS x").write.mode("append").parquet(source)
    changed, hit = cache.get(source, ["y"], build)
    assert not hit and changed.count() == 7 and len(built) == 3
    # A table whose writer did not commit is no hit.
    (tmp_path / "cache" / cache.path(source, ["y"]).rsplit("/", 1)[1] / "_SUCCESS").rename(tmp_path / "moved")
    assert not cache.get(source, ["y"], build)[1]
    with pytest.raises(FileNotFoundError):
        cache.get(str(tmp_path / "none"), ["y"], build)


def test_bundle(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 3), "a" if i % 2 else "b") for i in range(60)], "p double, q double, APP string")
    model = models.train(rows, models.decision_tree(min_rows=2), features=["p", "q"])
    moments = stats.Normalization([0.5], [1.0], [0.1, 0.2], [2.0, 3.0])
    bundle = models.Bundle(model, ["p", "q"], ["a", "b"], [1, 7], moments, {"depth": 30})
    path = str(tmp_path / "bundle")
    bundle.save(path)
    back = models.Bundle.load(spark, path)
    assert (back.features, back.labels, back.versions, back.parameters) == (["p", "q"], ["a", "b"], [1, 7], {"depth": "30"})
    _close(back.normalization, moments)
    one, two = (models.scorer(m).transform(rows.select("p", "q")).select("p", "y_pred").collect() for m in (model, back.model))
    assert sorted(one) == sorted(two)
    for broken, message in (("version", "version"), ("labels", "lacks labels"), ("other", "other labels")):
        row = spark.read.schema(models._BUNDLE).json(f"{path}/description")
        change = {"version": F.lit(9), "labels": F.lit(None).cast("array<string>"), "other": F.array(F.lit("a"), F.lit("c"))}[broken]
        target = str(tmp_path / broken)
        models.save(model, f"{target}/model")
        row.withColumn("version" if broken == "version" else "labels", change).write.json(f"{target}/description")
        with pytest.raises(ValueError, match=message):
            models.Bundle.load(spark, target)
