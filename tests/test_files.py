"""Readers and writers."""

import gzip

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from flowlens.operators import models, sampling, scoring
from flowlens.operators.stats import Normalization
from flowlens.plans import files, learning, views as v
from flowlens.schema import FLOW_SCHEMA
from flowlens.sources import readers, writers

COLUMNS = [name for name, _ in files.FLOW_FIELDS]


def csv_line(**values):
    return ",".join(str(values.get(c, "")) for c in COLUMNS)


@pytest.fixture
def day(tmp_path):
    path = tmp_path / "flows-20221121.csv.gz"
    lines = [
        ",".join(COLUMNS),
        csv_line(ID="a", BYTES=5, APP="x", PPI='"[[0, 1], [1, -1], [10, 20]]"'),
        csv_line(ID="b", BYTES="oops", APP="y"),
        csv_line(ID="c", BYTES=7),
    ]
    with gzip.open(path, "wt") as handle:
        handle.write("\n".join(lines) + "\n")
    return str(path)


def test_csv(spark, day):
    rows = {r["ID"]: r for r in readers.read_flow_csv(spark, day, ["ID", "BYTES", "PPI", "APP"]).collect()}
    assert rows["a"]["BYTES"] == 5 and rows["a"]["PPI"].startswith("[[0, 1]")
    assert rows["b"]["BYTES"] is None
    assert sorted(r["ID"] for r in readers.read_day(spark, day, ["ID"]).collect()) == ["a", "b"]
    corrupt = readers.read_flow_csv(spark, day, ["ID", "BYTES"], keep_corrupt=True)
    assert [r["ID"] for r in corrupt.filter("_corrupt_record is not null").collect()] == ["b"]


def test_convert(spark, day, tmp_path):
    out = str(tmp_path / "out")
    counts = writers.csv_to_parquet(spark, [day], out, ["ID", "BYTES", "APP"]).collect()
    assert [(r["source"], r["rows"]) for r in counts] == [("flows-20221121.parquet", 3)]
    table = readers.read_flow_parquet(spark, out)
    assert str(table.select("day").first()[0]) == "2022-11-21"
    assert sorted(table.columns) == ["APP", "BYTES", "ID", "day", "source"]


def test_convert_empty(spark, tmp_path):
    path = tmp_path / "flows-20221122.csv"
    path.write_text(",".join(COLUMNS) + "\n")
    out = str(tmp_path / "out")
    assert writers.csv_to_parquet(spark, str(path), out, ["ID", "BYTES"]).count() == 0
    table = readers.read_flow_parquet(spark, out, ["ID", "BYTES"])
    assert table.count() == 0 and dict(table.dtypes) == {"ID": "string", "BYTES": "bigint"}


def test_missing_and_empty_inputs(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_listed(spark, str(tmp_path), ["none.parquet"])
    with pytest.raises(ValueError):
        readers.read_listed(spark, str(tmp_path), [])
    with pytest.raises(AnalysisException):
        readers.read_folder(spark, str(tmp_path))
    (tmp_path / "traces.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.read_traces(spark, str(tmp_path / "traces.json"), as_list=True)


def test_listed_files(spark, tmp_path):
    for name in "ab":
        spark.range(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert readers.read_listed(spark, str(tmp_path), ["b.parquet", "a.parquet"]).count() == 6
    assert readers.rows_per_file(readers.read_folder(spark, str(tmp_path))).agg(F.sum("rows")).first()[0] == 6


def test_trace_list(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text('[{"ground_truth": "a", "sequences": [[1.0]], "tabular": [2], "version_idx": 1}]')
    row = readers.read_traces(spark, str(path), as_list=True).first()
    assert row["ground_truth"] == "a" and row["tabular"] == [2.0]


def test_manifest_round_trip(spark, sf, tmp_path):
    made = files._manifest(spark, sf)
    writers.write_json(made, str(tmp_path / "m"))
    back = readers.read_manifest(spark, str(tmp_path / "m"))
    assert back.first().asDict(recursive=True) == made.first().asDict(recursive=True)
    assert len(Normalization.of_manifest(back).tab_mean) == 45


def test_model_round_trip(spark, sf, tmp_path):
    train, valid = learning.features(spark, sf)
    model = models.train(train, models.decision_tree(min_rows=5, depth=5))
    models.save(model, str(tmp_path / "model"))
    loaded = models.load(str(tmp_path / "model"))
    first, second = (scoring.score(m, valid, keep=["ID"]).orderBy("ID").collect() for m in (model, loaded))
    assert first == second
    # Stray classes stand in no relation to the inputs, so the floor holds for the other rows.
    told = valid.filter(F.col("head_id") * 7919 % 100 >= learning.STRAY)
    assert scoring.score_with_truth(loaded, told).filter("matches").count() > 0.8 * told.count()
    with pytest.raises(Exception):
        models.load(str(tmp_path / "absent"))


def test_one_class_raises(spark, sf):
    train, _ = learning.features(spark, sf)
    with pytest.raises(ValueError):
        models.train(train.filter(F.col("APP") == train.first()["APP"]), models.decision_tree())


def test_requests(spark, sf):
    model, normalization, known, valid = learning._network(spark, sf)
    scored = scoring.score_requests(model, valid, normalization, known, keep=["ID"])
    assert scored.count() == valid.count()
    assert scored.filter("error is not null").count() == 0
    again = scoring.score_requests(
        model, valid.withColumn("tabular", F.concat("tabular", F.array(F.lit(9.0)))), normalization, known, ["ID"]
    )
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))


def test_split_is_a_partition(spark, sf):
    flows = v.flows(spark, sf, text=False).filter("APP is not null")
    split = sampling.stratified_split(flows, "APP", "head_id", 0.2)
    assert split.count() == flows.count()
    for row in split.groupBy("APP").agg(F.count("*").alias("n"), F.count_if("is_validation").alias("k")).collect():
        assert abs(row["k"] - 0.2 * row["n"]) <= 0.5


def test_schema_text():
    assert len(FLOW_SCHEMA.split(", ")) == 30


def test_one_versus_rest_probabilities(spark):
    """Boosting has margins only; its shares sum to 1, keep the margins' order and give a log loss."""
    rows = spark.range(240).select(
        (F.col("id") % 3).cast("string").alias("APP"),
        (F.col("id") % 3 + F.rand(1) * 0.1).alias("x"),
        F.rand(2).alias("y"),
    )
    model = models.train(rows, models.boosting(rounds=2, depth=2, bins=8), features=["x", "y"])
    scored = scoring.with_probabilities(models.scorer(model).transform(rows))
    found = scored.select("probabilities", "prediction").collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in found)
    assert all(max(range(3), key=r.probabilities.__getitem__) == int(r.prediction) for r in found)
    loss = scoring.evaluate_loss(model, rows).first()
    assert loss["rows"] == 240 and loss["correct"] > 200 and 0 < loss["log_loss"] < 1.1, loss
    assert scoring.score(model, rows).where("confidence IS NULL").count() == 0
