"""Packet streams: sources, count windows, sessions and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.functions.numeric import hash32
from flowlens.operators.scoring import score
from flowlens.schema import SEQUENCE_LENGTH
from flowlens.session import scratch_path


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    pattern: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream; `files_per_trigger` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_once(stream: DataFrame, output: str | None = None, marks: str | None = None) -> DataFrame:
    """Append everything available to a Parquet table and return that table.

    Calls with the same `output` and `marks` continue where the last one stopped.
    """
    spark = stream.sparkSession
    output = output or scratch_path(spark, "stream")
    marks = marks or scratch_path(spark, "marks")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand every available micro-batch to `handle`."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", scratch_path(stream.sparkSession, "marks"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class _CountWindow:
    """State step: collect packets of one flow and emit each full window.

    The state never holds more than one unfinished window.
    """

    def __init__(self, keys: list[str], length: int, unit_us: int, idle_ms: int | None):
        self.keys, self.length, self.unit_us, self.idle_ms = keys, length, unit_us, idle_ms

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, times, directions, sizes = state.get if state.exists else (0, [], [], [])
        held = list(zip(times, directions, sizes))
        arrived = pd.concat(list(batches)).sort_values(["ts_us", "packet_id"])
        rows = []
        for packet in zip(*(arrived[c].tolist() for c in ("ts_us", "direction", "size"))):
            if held and self.idle_ms is not None and packet[0] - held[-1][0] > self.idle_ms * 1000:
                held = []
            held.append(packet)
            if len(held) == self.length:
                rows.append((*key, count, held[0][0], held[-1][0], self._sequence(held)))
                held, count = [], count + 1
        state.update((count, *([p[i] for p in held] for i in range(3))))
        if self.idle_ms is not None:
            seen = int(arrived["ts_us"].max() // 1000)
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + self.idle_ms + 1)
        yield pd.DataFrame(rows, columns=[*self.keys, "window_no", "first_us", "last_us", "sequence"])

    def _sequence(self, held: list[tuple]) -> list[list[float]]:
        stamps, directions, sizes = zip(*held)
        gaps = [0] + [max(b - a, 0) // self.unit_us for a, b in zip(stamps, stamps[1:])]
        return [[float(v) for v in channel] for channel in (gaps, directions, sizes)]


def count_windows(
    packets: DataFrame,
    keys: Sequence[str],
    length: int = SEQUENCE_LENGTH,
    unit_us: int = 1000,
    delay: str | None = None,
    idle_ms: int | None = None,
) -> DataFrame:
    """Streaming form of the batch count windows.

    Packets are ordered by (ts_us, packet_id) within a micro-batch, which is also what one
    task holds of a flow: bound it with the source's rate limit. With `delay` the column
    `ts` gets a watermark, and with `idle_ms` as well packets older than it are dropped,
    a silence longer than `idle_ms` of event time discards the unfinished window, and the
    state of flows that stay silent is removed. Otherwise unfinished windows stay for ever.
    """
    rows = packets if delay is None else packets.withWatermark("ts", delay).filter(F.col("ts").isNotNull())
    fields = [rows.schema[k] for k in keys]
    output = T.StructType(
        [
            *fields,
            T.StructField("window_no", T.LongType()),
            T.StructField("first_us", T.LongType()),
            T.StructField("last_us", T.LongType()),
            T.StructField("sequence", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    state = T.StructType.fromDDL("count long, times array<long>, directions array<long>, sizes array<long>")
    timed = delay is not None and idle_ms is not None
    step = _CountWindow(list(keys), length, unit_us, idle_ms if timed else None)
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(step, output, state, "append", timeout)


def sessions(packets: DataFrame, keys: Sequence[str], idle: str, delay: str) -> DataFrame:
    """Flows that ended by silence, with their counters, once the watermark passes them."""
    forward = F.col("direction") == 1
    return (
        packets.withWatermark("ts", delay)
        .groupBy(*keys, F.session_window("ts", idle).alias("session"))
        .agg(
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.sum(F.when(forward, 1).otherwise(0)).alias("PACKETS"),
            F.sum(F.when(forward, 0).otherwise(1)).alias("PACKETS_REV"),
            F.sum(F.when(forward, F.col("size")).otherwise(0)).alias("BYTES"),
            F.sum(F.when(forward, 0).otherwise(F.col("size"))).alias("BYTES_REV"),
        )
        .drop("session")
    )


def packet_totals(packets: DataFrame) -> DataFrame:
    """Running packet and byte totals (complete output mode)."""
    return packets.groupBy().agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


def score_stream(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions for a stream of feature rows."""
    return score(model, rows, keep)


def write_replay(traces: DataFrame, path: str, id_column: str, files: int, epochs: int = 1, seed: int = 42) -> None:
    """Deal traces to `files` files in a random but repeatable way, once per epoch.

    A stream that takes one file per trigger then replays them, each epoch shuffled anew.
    """
    for epoch in range(epochs):
        place = hash32(F.col(id_column), seed=seed + epoch)
        dealt = traces.withColumn("_place", place).repartitionByRange(files, "_place", id_column)
        dealt.sortWithinPartitions("_place", id_column).drop("_place").write.mode("append").parquet(path)


def run_paced(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], seconds: float, marks: str | None = None
) -> StreamingQuery:
    """Start handing over one micro-batch every `seconds`; the caller stops the query."""
    marks = marks or scratch_path(stream.sparkSession, "marks")
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", marks)
        .trigger(processingTime=f"{int(seconds * 1000)} milliseconds")
        .start()
    )
