"""How often queries read the packets: assembled flows are written once and scanned from there."""

import pytest

import __spark_entry__ as driver
from flowlens.plans import views as v


def _records(spark):
    """Rows read by every stage so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.inputRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("name", ["zscore", "features_tabular", "tab_norm_stats", "class_weights", "label_encode", "manifest"])
def test_packets_are_read_three_times_at_most(name, spark, sf):
    packets = spark.read.parquet(f"{sf}/events.parquet").count()
    flows = v.flows(spark, sf).count()
    before = set(_records(spark))
    driver.queries()[name](spark, sf).collect()
    read = [n for stage, n in _records(spark).items() if stage not in before]
    # A stage that reads as many rows as there are packets reads the packets; the rest reads flows.
    assert flows < packets / 2 and sum(n // packets for n in read) <= 3, read
