"""Streams in several micro-batches against the batch operators."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import packets as pk
from flowlens.plans import views as v
from flowlens.streaming import packets as st


@pytest.fixture(scope="module")
def arrivals(spark, sf, tmp_path_factory):
    """The event table as five files in time order."""
    folder = str(tmp_path_factory.mktemp("arrivals"))
    events = v.table(spark, sf, "events").withColumn("part", F.col("event_id") * 5 / 1000)
    for i in range(5):
        chosen = events.filter(F.floor("part") == i).drop("part")
        assert chosen.count() == 200
        chosen.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    return v.events_to_packets(st.read_stream(spark, folder, v.LAYOUTS["events"], files_per_trigger=1))


def rows(df):
    return sorted(map(repr, df.select("flow_key", "window_no", "first_us", "last_us", "sequence").collect()))


def test_windows_across_batches(spark, sf, arrivals):
    expected = rows(pk.count_windows(v.packets(spark, sf), ["flow_key"], 10))
    assert expected
    assert rows(st.run_once(st.count_windows(stream(spark, arrivals), ["flow_key"], 10))) == expected


def test_windows_with_watermark(spark, sf, arrivals):
    """State kept long enough loses nothing."""
    windows = st.count_windows(stream(spark, arrivals), ["flow_key"], 10, delay="1 day", idle_ms=40 * 86_400_000)
    assert rows(st.run_once(windows)) == rows(pk.count_windows(v.packets(spark, sf), ["flow_key"], 10))


def test_long_silence_discards_the_window(spark, sf, arrivals):
    """Same windows as inside the flows that the same idle time cuts, whatever the batches."""
    day = 86_400_000
    windows = st.run_once(
        st.count_windows(stream(spark, arrivals), ["flow_key"], 5, delay="1 minute", idle_ms=day)
    )
    flows = pk.label_flows(v.packets(spark, sf), ["flow_key"], day * 1000)
    expected = pk.count_windows(flows.drop("position", "ipt", "turn", "_next_us"), ["flow_key", "flow_no"], 5)
    columns = ["flow_key", "first_us", "last_us", "sequence"]
    got, want = (sorted(map(repr, df.select(columns).collect())) for df in (windows, expected))
    assert got == want and got


def test_totals_per_batch(spark, sf, arrivals):
    seen = []
    st.run_batches(
        st.packet_totals(stream(spark, arrivals)),
        lambda batch, _: seen.append(batch.first()["packets"]),
        mode="complete",
    )
    assert seen[-1] == v.packets(spark, sf).count()
    assert seen == sorted(seen) and len(seen) >= 5


def test_paced_replay(spark, tmp_path):
    traces = spark.range(40).select(F.col("id"), F.lit("a").alias("ground_truth"))
    st.write_replay(traces, str(tmp_path / "replay"), "id", files=3, epochs=2)
    batches = []
    query = st.run_paced(
        st.read_stream(spark, str(tmp_path / "replay"), traces.schema, files_per_trigger=1),
        lambda batch, _: batches.append([r["id"] for r in batch.collect()]),
        seconds=0.2,
    )
    query.processAllAvailable()
    query.stop()
    assert sorted(x for b in batches for x in b) == sorted([*range(40)] * 2)
    assert len(batches) >= 6
