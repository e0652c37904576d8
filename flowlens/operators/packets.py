"""Packet rows to flows, packet sequences and count windows.

Packet tables carry `packet_id` (unique), `ts_us` (microseconds), `direction` (1 or -1)
and `size` (bytes) next to the key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.histogram import bin_index
from flowlens.functions.packet import is_quic_candidate
from flowlens.operators.joins import join_same
from flowlens.operators.ordered import ROWS_PER_TASK, OrderedRows
from flowlens.schema import HISTOGRAM_NAMES, HISTOGRAM_SIZE, SEQUENCE_LENGTH

ORDER = ["ts_us", "packet_id"]


def quic_packets(df: DataFrame) -> DataFrame:
    return df.filter(is_quic_candidate(F.col("protocol"), F.col("sport"), F.col("dport")))


def packet_gaps(
    packets: DataFrame, keys: Sequence[str], unit_us: int = 1000, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Inter-packet time of every packet of a key, 0 for the first, never negative."""
    rows = OrderedRows.of(packets, keys, ORDER, rows_per_task).with_neighbours({"_prev_us": "ts_us"})
    gap = F.greatest(F.coalesce(F.col("ts_us") - F.col("_prev_us"), F.lit(0)), F.lit(0))
    return rows.frame().withColumn("ipt", F.floor(gap / unit_us)).drop("_prev_us")


def label_flows(
    packets: DataFrame,
    keys: Sequence[str],
    idle_us: int,
    active_us: int | None = None,
    unit_us: int = 1000,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Packets with their flow number, position, inter-packet time and turn flag.

    A gap longer than `idle_us` opens a new flow. With `active_us` a flow is also cut at
    every multiple of that time after its first packet. `_next_us` is the key's following
    packet, whichever flow it belongs to.
    """
    gap = F.col("ts_us") - F.col("_prev_us")
    opens = F.col("_prev_us").isNull() | (gap > idle_us)
    rows = OrderedRows.of(packets, keys, ORDER, rows_per_task).with_neighbours(
        {"_prev_us": "ts_us", "_prev_dir": "direction"}, {"_next_us": "ts_us"}
    )
    rows = rows.map(lambda df: df.withColumn("_new", opens))
    if active_us:
        rows = rows.with_running(maxima={"_start_us": F.when(F.col("_new"), F.col("ts_us"))})

        def slot(ts: str) -> Column:
            return F.floor((F.col(ts) - F.col("_start_us")) / active_us)

        rows = rows.map(
            lambda df: df.withColumn("_new", F.col("_new") | (slot("ts_us") != slot("_prev_us"))).drop("_start_us")
        )
    rows = rows.with_running(sums={"flow_no": F.col("_new").cast("long"), "_row": F.lit(1)})
    rows = rows.with_running(maxima={"_first_row": F.when(F.col("_new"), F.col("_row"))})
    new = F.col("_new")
    return (
        rows.frame()
        .withColumns(
            {
                "position": F.col("_row") - F.col("_first_row"),
                "ipt": F.when(new, F.lit(0)).otherwise(F.floor(gap / unit_us)),
                "turn": F.when(new, F.lit(0)).otherwise((F.col("direction") != F.col("_prev_dir")).cast("int")),
            }
        )
        .drop("_prev_us", "_prev_dir", "_new", "_row", "_first_row")
    )


def _sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def with_bins(labelled: DataFrame) -> DataFrame:
    """Histogram bins of every packet; the first packet of a flow has no time bin."""
    return labelled.withColumns(
        {
            "_size_bin": bin_index("size"),
            "_ipt_bin": F.when(F.col("position") > 0, bin_index("ipt")),
        }
    )


def histogram_counts() -> dict[str, Column]:
    """Aggregates over `with_bins` rows: the four 8-bin histograms of a flow as arrays."""
    members = [(1, "_size_bin"), (-1, "_size_bin"), (1, "_ipt_bin"), (-1, "_ipt_bin")]
    result = {}
    for name, (sign, value) in zip(HISTOGRAM_NAMES, members):
        counts = [f"count_if(direction = {sign} AND {value} = {i})" for i in range(HISTOGRAM_SIZE)]
        result[name] = F.expr(f"array({', '.join(counts)})")
    return result


def sequence_of(length: int = SEQUENCE_LENGTH) -> Column:
    """Aggregate: the first `length` packets as [[times], [directions], [sizes]]."""
    packet = F.struct("position", "ipt", "direction", "size")
    ordered = F.array_sort(F.collect_list(F.when(F.col("position") < length, packet)))

    def values(field: str) -> Column:
        return F.transform(ordered, lambda p: p[field].cast("double"))

    return F.array(values("ipt"), values("direction"), values("size"))


def assemble_flows(
    labelled: DataFrame,
    keys: Sequence[str],
    idle_us: int,
    capture_end_us: Column | None = None,
    first: Sequence[str] = (),
    last: Sequence[str] = (),
    length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """One row per flow from `label_flows` rows.

    `capture_end_us` is the time the capture stopped, a literal or a scalar subquery. `first` and `last` name columns taken from a flow's first and last packet. Every
    aggregate is combined before the shuffle, so long flows do not gather in one task.
    A flow ends idle when silence longer than the timeout follows, active when the next
    packet comes sooner, and otherwise (end of capture) for other reasons.
    """
    forward = F.col("direction") == 1
    inside = F.col("position") < length
    begins = F.col("position") == 0
    ending = F.max_by(F.struct("_next_us", *last), "position")
    seconds = 1e6
    flows = with_bins(labelled).groupBy(*keys, "flow_no").agg(
        F.count(F.lit(1)).alias("_packets"),
        _sum_where(forward, F.lit(1)).alias("PACKETS"),
        _sum_where(~forward, F.lit(1)).alias("PACKETS_REV"),
        _sum_where(forward, F.col("size")).alias("BYTES"),
        _sum_where(~forward, F.col("size")).alias("BYTES_REV"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.max(F.when(inside, F.col("ts_us"))).alias("_ppi_end"),
        _sum_where(inside, F.col("turn")).cast("int").alias("PPI_ROUNDTRIPS"),
        sequence_of(length).alias("PPI"),
        *[column.alias(name) for name, column in histogram_counts().items()],
        *[F.max(F.when(begins, F.col(c))).alias(c) for c in first],
        ending.alias("_end"),
    )
    stop = F.lit(None).cast("long") if capture_end_us is None else capture_end_us
    silence = F.coalesce(F.col("_end._next_us"), stop) - F.col("last_us")
    idle = F.coalesce(silence > idle_us, F.lit(False))
    active = ~idle & F.col("_end._next_us").isNotNull()
    return flows.withColumns(
        {
            "DURATION": (F.col("last_us") - F.col("first_us")) / seconds,
            "TIME_FIRST": F.timestamp_micros("first_us"),
            "TIME_LAST": F.timestamp_micros("last_us"),
            "PPI_LEN": F.least(F.col("_packets"), F.lit(length)).cast("int"),
            "PPI_DURATION": (F.col("_ppi_end") - F.col("first_us")) / seconds,
            "FLOW_ENDREASON_IDLE": idle.cast("int"),
            "FLOW_ENDREASON_ACTIVE": active.cast("int"),
            "FLOW_ENDREASON_OTHER": (~idle & ~active).cast("int"),
            **{c: F.col("_end")[c] for c in last},
        }
    ).drop("_packets", "_ppi_end", "_end")


def first_packets(labelled: DataFrame, keys: Sequence[str], length: int = SEQUENCE_LENGTH) -> DataFrame:
    """First `length` packets of every flow as one sequence row."""
    return (
        labelled.filter(F.col("position") < length)
        .groupBy(*keys, "flow_no")
        .agg(F.count(F.lit(1)).alias("packets"), sequence_of(length).alias("sequence"))
    )


def count_windows(
    packets: DataFrame,
    keys: Sequence[str],
    length: int = SEQUENCE_LENGTH,
    unit_us: int = 1000,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every full run of `length` packets of a key as one sequence; the rest is left out.

    Windows do not overlap and each starts with inter-packet time 0.
    """
    rows = OrderedRows.of(packets, keys, ORDER, rows_per_task)
    rows = rows.with_neighbours({"_prev_us": "ts_us"}).with_running(sums={"_row": F.lit(1)})
    at = F.col("_row") - 1
    gap = F.greatest(F.col("ts_us") - F.col("_prev_us"), F.lit(0))
    placed = rows.frame().withColumns(
        {
            "window_no": F.floor(at / length),
            "position": at % length,
            "ipt": F.when(at % length == 0, F.lit(0)).otherwise(F.floor(gap / unit_us)),
        }
    )
    return (
        placed.groupBy(*keys, "window_no")
        .agg(
            F.count(F.lit(1)).alias("_packets"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            sequence_of(length).alias("sequence"),
        )
        .filter(F.col("_packets") == length)
        .drop("_packets")
    )


def packet_stats(packets: DataFrame, keys: Sequence[str], values: Sequence[str] = ("size", "ipt")) -> DataFrame:
    """Count, total, mean, median, standard deviation, minimum and maximum per key.

    Values are whole bytes or time units. The median comes from counts per distinct value, which
    are rows of a sort that may spill, so a huge key holds nothing of that kind in memory.
    """
    forward = F.col("direction") == 1
    columns = [
        F.count(F.lit(1)).alias("packets"),
        F.count_if(forward).alias("packets_fwd"),
        F.count_if(~forward).alias("packets_rev"),
    ]
    for value in values:
        columns += [
            F.sum(value).alias(f"{value}_total"),
            F.avg(value).alias(f"{value}_mean"),
            F.stddev_samp(value).alias(f"{value}_std"),
            F.min(value).alias(f"{value}_min"),
            F.max(value).alias(f"{value}_max"),
        ]
    stats = packets.groupBy(*keys).agg(*columns)
    return join_same(stats, _medians(packets, keys, values), list(keys), "left")


def _medians(packets: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians per key, NULL values left out."""
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    counted = (
        packets.select(*keys, F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = Window.partitionBy(*keys, "name")
    before = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"_upto": F.sum("n").over(before), "_all": F.sum("n").over(group)})
    # The one or two middle rows lie in the values that reach either half.
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda place: (F.col("_upto") >= place) & (F.col("_upto") - F.col("n") < place)
    middle = placed.select(*keys, "name", F.when(holds(low), F.col("value")).alias("low"), F.when(holds(high), F.col("value")).alias("high"))
    return middle.groupBy(*keys).agg(
        *[
            ((F.max(F.when(F.col("name") == v, F.col("low"))) + F.max(F.when(F.col("name") == v, F.col("high")))) / 2).alias(
                f"{v}_median"
            )
            for v in values
        ]
    )


def flow_histograms(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The four packet histograms of every flow."""
    return with_bins(labelled).groupBy(*keys, "flow_no").agg(
        *[column.alias(name) for name, column in histogram_counts().items()]
    )


def bin_counts(packets: DataFrame, value: str) -> DataFrame:
    """Packets per histogram bin over the whole table."""
    return packets.groupBy(bin_index(value).alias("bin")).agg(F.count(F.lit(1)).alias("packets"))


def last_packets(packets: DataFrame, rows: int = 20) -> DataFrame:
    """The newest packets, as a log."""
    return packets.orderBy(F.col("ts_us").desc(), F.col("packet_id").desc()).limit(rows)


def sequence_rows(flows: DataFrame, keep: Sequence[str], sequence: str) -> DataFrame:
    """One row per packet of a sequence column: position, ipt, direction, size."""
    packet = F.arrays_zip(
        *[F.get(F.col(sequence), F.lit(i)).alias(n) for i, n in enumerate(("ipt", "direction", "size"))]
    )
    return flows.select(*keep, F.posexplode(packet).alias("position", "_packet")).select(
        *keep, "position", F.col("_packet.ipt"), F.col("_packet.direction"), F.col("_packet.size")
    )


