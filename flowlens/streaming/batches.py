"""Flow export and count windows by micro-batches, with DataFrame operators only.

What a micro-batch leaves open is written next to its results, both under the number of the
batch. A batch reads the state of the batch before it and overwrites its own folders, so a batch that
is repeated after a failure changes nothing. Rows are ordered by `OrderedRows`, so a key with most
of a batch's rows is split over tasks like in the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.operators.ordered import ROWS_PER_TASK, OrderedRows
from flowlens.operators.packets import ORDER, sequence_of
from flowlens.operators.scoring import split_requests
from flowlens.schema import SEQUENCE_LENGTH
from flowlens.session import delete_path

COUNTERS = ["PACKETS", "PACKETS_REV", "BYTES", "BYTES_REV"]


class Versions:
    """Tables below a shared folder with one version per micro-batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/batch={batch_id}"

    def write(self, table: DataFrame, name: str, batch_id: int) -> DataFrame:
        table.write.mode("overwrite").parquet(self._path(name, batch_id))
        return self.spark.read.schema(table.schema).parquet(self._path(name, batch_id))

    def before(self, name: str, batch_id: int, schema: str) -> DataFrame:
        """The version of the batch before; empty for the first batch."""
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, batch_id - 1))

    def forget(self, name: str, batch_id: int) -> None:
        """Drop state that no repeated batch can ask for any more."""
        if batch_id >= 2:
            delete_path(self.spark, self._path(name, batch_id - 2))

    def all(self, name: str, schema: str) -> DataFrame:
        """The results of all batches."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{name}")


def _fields(rows: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


class FlowExport:
    """Flows of a packet stream, exported with the reason of their end.

    A flow ends by silence (longer than `idle_us`), at a multiple of `active_us` after its first
    packet when a further packet comes, and for other reasons when the stream is closed. Packets wait until
    the watermark (`delay_us` behind the newest packet) has passed them and are then taken in the order
    of their times, whatever order they came in. Packets behind the watermark of an earlier batch come
    too late; they are kept apart in `late`. The state is one row per open flow and the waiting packets.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], idle_us: int, active_us: int, delay_us: int,
                 rows_per_task: int = ROWS_PER_TASK):
        self.tables = Versions(spark, root)
        self.keys, self.idle_us, self.active_us, self.delay_us = list(keys), idle_us, active_us, delay_us
        self.rows_per_task = rows_per_task
        self._batches = 0
        self._schemas: dict[str, str] = {}

    def _layouts(self, packets: DataFrame) -> dict[str, str]:
        key = _fields(packets, self.keys)
        counters = ", ".join(f"{c} long" for c in COUNTERS)
        flow = f"{key}, first_us long, last_us long, {counters}"
        return {
            "open": f"{flow}, idle_start_us long",
            "flows": f"{flow}, end_reason string",
            "waiting": f"{key}, ts_us long, packet_id long, direction int, size long",
            "late": f"{key}, ts_us long, packet_id long, direction int, size long",
            "clock": "newest long",
        }

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """Process one micro-batch; pass it to `foreachBatch`."""
        self._schemas = self._layouts(batch)
        tables, schemas = self.tables, self._schemas
        came = batch.select(
            *self.keys, "ts_us", "packet_id", F.col("direction").cast("int").alias("direction"), F.col("size").cast("long").alias("size")
        ).filter(F.col("ts_us").isNotNull()).persist()
        before = tables.before("clock", batch_id, schemas["clock"]).first()
        old = before["newest"] if before else None
        newest = max((t for t in (old, came.agg(F.max("ts_us")).first()[0]) if t is not None), default=None)
        tables.write(tables.spark.createDataFrame([(newest,)], schemas["clock"]), "clock", batch_id)
        passed = F.lit(False) if old is None else F.col("ts_us") <= old - self.delay_us
        tables.write(came.filter(passed), "late", batch_id)
        held = tables.before("waiting", batch_id, schemas["waiting"]).unionByName(came.filter(~passed))
        watermark = None if newest is None else newest - self.delay_us
        due = F.lit(False) if watermark is None else F.col("ts_us") <= watermark
        tables.write(held.filter(~due), "waiting", batch_id)
        self._advance(held.filter(due), batch_id, watermark)
        came.unpersist()
        for name in ("clock", "waiting", "open"):
            tables.forget(name, batch_id)
        self._batches = batch_id + 1

    def close(self) -> DataFrame:
        """End the stream: take the waiting packets, export all open flows and return the flows of all batches."""
        tables, schemas, batch_id = self.tables, self._schemas, self._batches
        newest = tables.before("clock", batch_id, schemas["clock"]).first()["newest"]
        self._advance(tables.before("waiting", batch_id, schemas["waiting"]), batch_id, newest, last=True)
        return tables.all("flows", schemas["flows"])

    def _advance(self, packets: DataFrame, batch_id: int, now: int | None, last: bool = False) -> None:
        """Take packets in order, export the flows that ended by `now` and keep the open ones."""
        keys, tables = self.keys, self.tables
        forward = F.col("direction") == 1
        one = lambda is_forward, value: F.when(is_forward, value).otherwise(F.lit(0)).cast("long")
        new = packets.select(
            *keys, "ts_us", "packet_id", F.col("ts_us").alias("first_us"), F.lit(None).cast("long").alias("idle_start_us"),
            one(forward, F.lit(1)).alias("PACKETS"), one(~forward, F.lit(1)).alias("PACKETS_REV"),
            one(forward, F.col("size")).alias("BYTES"), one(~forward, F.col("size")).alias("BYTES_REV"),
        )
        # An open flow stands as one row at its last packet, before all packets still to come.
        held = tables.before("open", batch_id, self._schemas["open"]).select(
            *keys, F.col("last_us").alias("ts_us"), F.lit(-1).cast("long").alias("packet_id"), "first_us", "idle_start_us", *COUNTERS
        )
        rows = OrderedRows.of(held.unionByName(new), keys, ORDER, self.rows_per_task)
        rows = rows.with_neighbours({"_prev_us": "ts_us"}, {"_next_us": "ts_us"})
        silent = F.col("_prev_us").isNull() | (F.col("ts_us") - F.col("_prev_us") > self.idle_us)
        rows = rows.map(lambda df: df.withColumn("_new", silent))
        rows = rows.with_running(maxima={"_start_us": F.when(F.col("_new"), F.coalesce("idle_start_us", "ts_us"))})

        def slot(ts: str) -> Column:
            return F.floor((F.col(ts) - F.col("_start_us")) / self.active_us)

        cut = F.coalesce(slot("ts_us") != slot("_prev_us"), F.lit(False))
        rows = rows.map(lambda df: df.withColumn("_new", F.col("_new") | cut))
        rows = rows.with_running(sums={"_flow": F.col("_new").cast("long")}).frame()
        flows = rows.groupBy(*keys, "_flow").agg(
            F.min("first_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            *[F.sum(c).cast("long").alias(c) for c in COUNTERS],
            F.max("_start_us").alias("idle_start_us"),
            F.max_by("_next_us", F.struct(*ORDER)).alias("_next_us"),
        )
        silence = F.coalesce(F.col("_next_us"), F.lit(now).cast("long")) - F.col("last_us")
        ended = F.when(silence > self.idle_us, "idle").when(F.col("_next_us").isNotNull(), "active")
        # Any packet still to come is later than the watermark.
        gone = F.when(F.col("_next_us").isNull() & (silence >= self.idle_us), "idle")
        reason = F.coalesce(ended, F.lit("other")) if last else F.coalesce(ended, gone)
        flows = flows.withColumn("end_reason", reason).persist()
        columns = [*keys, "first_us", "last_us", *COUNTERS]
        tables.write(flows.filter(F.col("end_reason").isNotNull()).select(*columns, "end_reason"), "flows", batch_id)
        tables.write(flows.filter(F.col("end_reason").isNull()).select(*columns, "idle_start_us"), "open", batch_id)
        flows.unpersist()


class CountWindows:
    """Count windows of a packet stream: every full run of `length` packets of a key, in the order of arrival.

    Packets are ordered by (ts_us, packet_id) inside a micro-batch. The state is one row per key: the number
    of windows so far and fewer than `length` packets.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], length: int = SEQUENCE_LENGTH, unit_us: int = 1000,
                 rows_per_task: int = ROWS_PER_TASK):
        self.tables = Versions(spark, root)
        self.keys, self.length, self.unit_us, self.rows_per_task = list(keys), length, unit_us, rows_per_task
        self.schema = ""

    def handle(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Process one micro-batch; its full windows are written and returned."""
        keys, length, tables = self.keys, self.length, self.tables
        key = _fields(batch, keys)
        self.schema = f"{key}, window_no long, first_us long, last_us long, sequence array<array<double>>"
        packet = "struct<at:int,ts_us:long,packet_id:long,direction:int,size:long>"
        state = tables.before("held", batch_id, f"{key}, done long, held array<{packet}>")
        rest = state.select(*keys, F.inline("held"))
        came = batch.select(
            *keys, F.lit(length).alias("at"), "ts_us", "packet_id",
            F.col("direction").cast("int").alias("direction"), F.col("size").cast("long").alias("size"),
        ).persist()
        rows = OrderedRows.of(rest.unionByName(came), keys, ["at", *ORDER], self.rows_per_task)
        rows = rows.with_neighbours({"_prev_us": "ts_us"}).with_running(sums={"_row": F.lit(1)})
        place = F.col("_row") - 1
        gap = F.greatest(F.col("ts_us") - F.col("_prev_us"), F.lit(0))
        placed = rows.frame().withColumns(
            {
                "_window": F.floor(place / length),
                "position": place % length,
                "ipt": F.when(place % length == 0, F.lit(0)).otherwise(F.floor(gap / self.unit_us)),
            }
        )
        kept = F.struct(F.col("position").cast("int").alias("at"), "ts_us", "packet_id", "direction", "size")
        groups = placed.groupBy(*keys, "_window").agg(
            F.count(F.lit(1)).alias("_packets"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            sequence_of(length).alias("sequence"),
            # At most `length` packets share a window.
            F.array_sort(F.collect_list(kept)).alias("held"),
        )
        groups = groups.persist()
        full = F.col("_packets") == length
        now = groups.groupBy(*keys).agg(
            F.count_if(full).alias("_more"), F.first(F.when(~full, F.col("held")), ignorenulls=True).alias("_held")
        )
        both = state.join(now, keys, "full")
        none = F.array().cast(f"array<{packet}>")
        moved = both.select(
            *keys,
            (F.coalesce("done", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("long").alias("done"),
            F.when(F.col("_more").isNotNull(), F.coalesce("_held", none)).otherwise(F.col("held")).alias("held"),
        )
        numbered = groups.filter(full).join(state.select(*keys, "done"), keys, "left").select(
            *keys, (F.coalesce("done", F.lit(0)) + F.col("_window")).cast("long").alias("window_no"), "first_us", "last_us", "sequence"
        )
        windows = tables.write(numbered, "windows", batch_id)
        tables.write(moved, "held", batch_id)
        groups.unpersist()
        came.unpersist()
        tables.forget("held", batch_id)
        return windows

    def windows(self) -> DataFrame:
        return self.tables.all("windows", self.schema)


class WindowScores:
    """Full windows of a packet stream as requests: scores in one table, rejected requests in another.

    `request` turns windows into rows with `sequences`; `score` adds the answer to valid ones. Both
    tables are written under the batch number, like the windows themselves.
    """

    def __init__(self, windows: CountWindows, request: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame]):
        self.windows, self.request, self.score = windows, request, score
        self._schemas: dict[str, str] = {}

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        good, bad = split_requests(self.request(self.windows.handle(batch, batch_id)), self.windows.length)
        for name, rows in (("scores", self.score(good)), ("errors", bad.drop("sequences"))):
            self._schemas[name] = _fields(rows, rows.columns)
            self.windows.tables.write(rows, name, batch_id)

    def table(self, name: str) -> DataFrame:
        return self.windows.tables.all(name, self._schemas[name])
