"""Replay of a stored table as an endless stream: epoch after epoch, each in an order of its own.

The table is written once with its rows numbered. A counting source gives each micro-batch a range of
slots; a seeded permutation turns (epoch, slot) into a row number, and the batch joins the table on it. No
epoch is written or sorted, and the offset in the stream's checkpoint says where a restart goes on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowlens.operators.joins import BROADCAST_ROWS
from flowlens.session import scratch_path

#: Rounds of the permutation.
ROUNDS = 4


def number_rows(rows: DataFrame, path: str, *order: str) -> None:
    """Write the rows, sorted, with their part and their place in it; equal rows take any order among them."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    sorted_rows.withColumns({"_part": F.spark_partition_id(), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)


def _numbered(stored: DataFrame) -> DataFrame:
    """Rows with their number from 0; as many offsets are broadcast as the table has parts."""
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return stored.join(F.broadcast(starts), "_part").withColumn("_number", F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


@dataclass
class Replay:
    """Replays the table at `path`, `batch_slots` slots a micro-batch.

    An epoch has the next square of the number of rows as slots, so that the slots split into two halves the
    permutation mixes; the few slots beyond the rows stay empty. `epochs` ends the replay, None goes on.
    """

    spark: SparkSession
    path: str
    batch_slots: int
    epochs: int | None = None
    seed: int = 42

    def __post_init__(self):
        self.stored = self.spark.read.parquet(self.path)
        self.rows = self.stored.count()
        self.side = math.isqrt(max(self.rows - 1, 0)) + 1
        self.slots = self.side**2

    @classmethod
    def of(cls, rows: DataFrame, id_column: str, batch_slots: int, epochs: int | None = None, seed: int = 42, path: str | None = None) -> "Replay":
        """Store the rows, in the order of an id, and replay them; columns named `epoch` or `position` are errors."""
        taken = {"epoch", "position", "_part", "_at"} & {c.lower() for c in rows.columns}
        if taken:
            raise ValueError(f"the replay adds columns named {sorted(taken)}")
        path = path or scratch_path(rows.sparkSession, "replay")
        number_rows(rows, path, id_column)
        return cls(rows.sparkSession, path, batch_slots, epochs, seed)

    def _row_numbers(self, counted: DataFrame) -> DataFrame:
        """epoch, position and row number of counted slots."""
        slot = F.col("value") % self.slots
        found = counted.select("value", F.floor(F.col("value") / self.slots).cast("long").alias("epoch"), slot.alias("position"))
        found = found.withColumns({"_l": F.floor(F.col("position") / self.side).cast("long"), "_r": F.col("position") % self.side})
        for i in range(ROUNDS):
            shift = F.pmod(F.xxhash64(F.lit(self.seed), "epoch", F.lit(i), "_r"), F.lit(self.side))
            found = found.withColumns({"_l": F.col("_r"), "_r": (F.col("_l") + shift) % self.side})
        found = found.withColumn("_number", F.col("_l") * self.side + F.col("_r")).filter(F.col("_number") < self.rows)
        if self.epochs is not None:
            found = found.filter(F.col("value") < self.slots * self.epochs)
        return found.select("epoch", "position", "_number")

    def stream(self) -> DataFrame:
        """The table's columns with epoch and position (slot within the epoch, the order of the replay)."""
        counted = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", self.batch_slots).load()
        wanted = self._row_numbers(counted)
        # A batch has no more rows than slots, which bounds what is broadcast.
        if self.batch_slots <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        return _numbered(self.stored).join(wanted, "_number").drop("_number")

    def run(self, handle: Callable[[DataFrame, int], None], marks: str, batches: int | None = None) -> int:
        """Hand over micro-batches until the epochs end, or for `batches` of them; the slots replayed so far.

        A call with the same `marks` goes on where the last one ended.
        """
        if self.epochs is None and batches is None:
            raise ValueError("an endless replay needs a number of batches")
        done, taken = 0, 0
        while batches is None or taken < batches:
            query = (
                self.stream().writeStream.foreachBatch(handle).option("checkpointLocation", marks)
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
            done, taken = _offset(query.lastProgress, done), taken + 1
            if self.epochs is not None and done >= self.slots * self.epochs:
                break
        return done


def _offset(progress, before: int) -> int:
    """The counting source's end offset, which progress shows as the text of a mapping."""
    ends = [str(s["endOffset"]) for s in progress["sources"]] if progress is not None else []
    found = [re.search(r"\boffset\W+(\d+)", end) for end in ends]
    return next((int(f.group(1)) for f in found if f), before)
