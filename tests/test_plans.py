"""Physical plans: what is read, shuffled and broadcast."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from flowlens.operators import packets as pk, sampling, tabular
from flowlens.operators.encode import Dictionary
from flowlens.plans import files, views as v
from flowlens.sources import readers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "flows")
    flows = files.export_layout(v.flows(spark, sf)).withColumn("day", F.substring("TIME_FIRST", 1, 10))
    flows.write.partitionBy("day").parquet(path)
    return readers.read_flow_parquet(spark, path)


def test_feature_table_reads_only_its_inputs(stored):
    labelled = stored.filter(F.col("APP").isNotNull())
    text = plan(tabular.feature_table(labelled, keep=["ID", "APP"]))
    assert "PushedFilters: [IsNotNull(APP)]" in text
    assert not any(f"{name}#" in text for name in ("QUIC_SNI", "SRC_IP", "PPI"))
    assert "Exchange" not in text


def test_encoding_does_not_shuffle_rows(stored):
    versions = Dictionary.fit(stored, "QUIC_VERSION", first=1)
    text = plan(tabular.feature_table(stored, versions, keep=["ID"]))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_time_split_prunes_days(stored):
    train, held = sampling.time_split(stored, "day", 0.2)
    for part in (train, held):
        assert "PartitionFilters: [day" in plan(part.select("ID"))


def test_flows_need_one_shuffle(spark, sf):
    text = plan(v.flows(spark, sf, text=False))
    # The second exchange brings the one-row capture end of the subquery together.
    assert text.count("Exchange hashpartitioning") == 1


def test_flow_sequence_needs_one_shuffle(spark, sf):
    assert plan(pk.first_packets(v.labelled(spark, sf), ["flow_key"])).count("Exchange hashpartitioning") == 1


def test_per_class_picks_are_limited_before_the_shuffle(stored):
    text = plan(sampling.first_per_class(stored, "APP", ["view", "click"], 10, ["TIME_FIRST", "ID"]))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning")


def test_stratified_split_leaves_rows_in_place(stored):
    text = plan(sampling.stratified_split(stored.filter("APP is not null"), "APP", "ID"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_sample_leaves_rows_in_place(stored):
    text = plan(sampling.sample_rows(stored, 20, "ID").select("ID"))
    assert "hashpartitioning" not in text


@pytest.mark.parametrize("name", ["features_tabular", "label_encode", "class_report", "zscore", "sampling_ratio", "sample_exact"])
def test_no_cross_joins(spark, sf, name):
    text = plan(driver.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
