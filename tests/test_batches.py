"""Micro-batch windows and flow export against the batch operators: repeated batches, hot keys, late packets."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowlens.operators import packets as pk
from flowlens.plans import streams, views as v
from flowlens.session import scratch_path
from flowlens.streaming import batches as B

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def packets(spark, sf):
    """Packets with half of them moved to one key."""
    rows = v.packets(spark, sf).withColumn("flow_key", F.when(F.col("packet_id") % 2 == 0, 0).otherwise(F.col("flow_key")))
    return rows.cache()


def _split(packets, n=5):
    """The packets in `n` parts by time."""
    edges = packets.approxQuantile("ts_us", [i / n for i in range(1, n)], 0.0)
    part = sum((F.when(F.col("ts_us") > e, 1).otherwise(0) for e in edges), F.lit(0))
    return [packets.filter(part == i) for i in range(n)]


def _rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


WINDOW = ["flow_key", "window_no", "first_us", "last_us", "sequence"]


@pytest.mark.parametrize("rows_per_task", [10_000, 25])
def test_windows_of_a_hot_key_and_repeated_batches(spark, packets, rows_per_task):
    windows = B.CountWindows(spark, scratch_path(spark, "w"), ["flow_key"], 10, rows_per_task=rows_per_task)
    for i, part in enumerate(_split(packets)):
        windows.handle(part, i)
        if i % 2:
            windows.handle(part, i)
    want = _rows(pk.count_windows(packets, ["flow_key"], 10), *WINDOW)
    assert _rows(windows.windows(), *WINDOW) == want and len(want) > 40


def test_batch_without_packets_keeps_the_state(spark, packets):
    windows = B.CountWindows(spark, scratch_path(spark, "w"), ["flow_key"], 10)
    first, second = _split(packets, 2)
    for i, part in enumerate((first, first.limit(0), second)):
        windows.handle(part, i)
    assert _rows(windows.windows(), *WINDOW) == _rows(pk.count_windows(packets, ["flow_key"], 10), *WINDOW)


def _batch_flows(packets, idle, active):
    labelled = pk.label_flows(packets, ["flow_key"], idle, active)
    flows = pk.assemble_flows(labelled, ["flow_key"], idle, packets.agg(F.max("ts_us")).scalar())
    reason = F.when(F.col("FLOW_ENDREASON_IDLE") == 1, "idle").when(F.col("FLOW_ENDREASON_ACTIVE") == 1, "active").otherwise("other")
    return flows.withColumn("end_reason", reason)


FLOW = ["flow_key", "first_us", "last_us", *B.COUNTERS, "end_reason"]


@pytest.mark.parametrize("rows_per_task, delay", [(10_000, 0), (10_000, 3 * DAY), (25, DAY)])
def test_export_equals_batch_flows(spark, packets, rows_per_task, delay):
    """Five batches, two of them handled twice; all reasons occur."""
    export = B.FlowExport(spark, scratch_path(spark, "e"), ["flow_key"], DAY, 3 * DAY, delay, rows_per_task)
    for i, part in enumerate(_split(packets)):
        export.handle(part, i)
        if i in (0, 3):
            export.handle(part, i)
    got = export.close()
    want = _batch_flows(packets, DAY, 3 * DAY)
    assert _rows(got, *FLOW) == _rows(want, *FLOW)
    assert {r.end_reason for r in got.select("end_reason").distinct().collect()} == {"idle", "active", "other"}


def test_disorder_within_the_delay_and_late_packets(spark, packets):
    """Packets up to the delay behind are sorted in; older ones are kept apart and change no flow."""
    parts = _split(packets)
    edge = parts[3].agg(F.min("ts_us")).first()[0]
    swapped = (F.col("ts_us") > edge - DAY) & (F.col("ts_us") < edge + DAY) & (F.col("packet_id") % 3 == 0)
    late = (F.col("packet_id") % 50 == 7) & (F.col("ts_us") < parts[1].agg(F.max("ts_us")).first()[0])
    order = [p.filter(~swapped & ~late) for p in parts]
    order[4] = order[4].unionByName(packets.filter(late & ~swapped))
    order[3] = order[3].unionByName(packets.filter(swapped & ~late))
    export = B.FlowExport(spark, scratch_path(spark, "e"), ["flow_key"], DAY, 3 * DAY, 3 * DAY)
    for i, part in enumerate(order):
        export.handle(part, i)
    got = export.close()
    kept = packets.filter(~late)
    assert _rows(got, *FLOW) == _rows(_batch_flows(kept, DAY, 3 * DAY), *FLOW)
    apart = export.tables.all("late", "flow_key long, packet_id long")
    missing = packets.filter(late).select("packet_id")
    assert _rows(apart, "packet_id") == _rows(missing, "packet_id") and missing.count() > 5


def test_scores_and_error_rows_of_a_repeated_batch(spark, packets):
    windows = B.CountWindows(spark, scratch_path(spark, "s"), ["flow_key"], 10)
    broken = F.col("window_no") % 4 == 1

    def request(rows):
        cut = F.when(broken, F.slice("sequence", 1, 2)).otherwise(F.col("sequence"))
        return rows.select("flow_key", "window_no", cut.alias("sequences"))

    scores = B.WindowScores(windows, request, lambda rows: rows.select("flow_key", "window_no", F.lit("x").alias("label")))
    for i, part in enumerate(_split(packets)):
        scores.handle(part, i)
        scores.handle(part, i)
    total = pk.count_windows(packets, ["flow_key"], 10)
    assert _rows(scores.table("errors"), "flow_key", "window_no") == _rows(total.filter(broken), "flow_key", "window_no")
    assert _rows(scores.table("scores"), "flow_key", "window_no") == _rows(total.filter(~broken), "flow_key", "window_no")
    assert {r.label for r in scores.table("errors").collect()} == {"API_ERROR"}


@pytest.mark.parametrize("make", ["windows", "export"])
def test_packets_of_a_batch_are_computed_once(spark, packets, make):
    path = scratch_path(spark, make)
    state = B.CountWindows(spark, path, ["flow_key"], 10) if make == "windows" else B.FlowExport(spark, path, ["flow_key"], DAY, 3 * DAY, 1000)
    seen = spark.sparkContext.accumulator(0)

    def counted(size):
        seen.add(1)
        return size

    some = packets.limit(300).cache()
    assert some.count() == 300
    state.handle(some.withColumn("size", F.udf(counted, "long")("size")), 0)
    assert seen.value == 300


def test_tasks_share_the_file_of_a_batch(spark, sf, monkeypatch):
    monkeypatch.setattr(streams, "GROUP_BYTES", 1024)
    made = []
    monkeypatch.setattr(streams, "scratch_path", lambda s, name: made.append(scratch_path(s, name)) or made[-1])
    arrivals = streams._arrivals(spark, sf)
    assert arrivals.isStreaming
    files = glob.glob(f"{next(m for m in made if 'arrivals' in m)}/*.parquet")
    assert len(files) == 5 and all(pq.ParquetFile(f).num_row_groups > 1 for f in files)
