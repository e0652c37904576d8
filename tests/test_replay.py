"""Replay by offsets: whole epochs, an order of their own each, and restarts."""

import pytest
from pyspark.sql import functions as F

from flowlens.streaming.replay import Replay


def _traces(spark, n):
    return spark.range(n).select((F.col("id") * 3).alias("id"), F.concat(F.lit("t"), "id").alias("name"))


def _collect(batches):
    return lambda batch, number: batches.setdefault(number, sorted((r["epoch"], r["position"], r["id"]) for r in batch.collect()))


@pytest.mark.parametrize("n", [1, 37, 49])
def test_every_epoch_holds_all_rows_in_its_own_order(spark, tmp_path, n):
    replay = Replay.of(_traces(spark, n).repartition(3), "id", batch_slots=40, epochs=2)
    seen: dict = {}
    assert replay.run(_collect(seen), str(tmp_path / "marks")) >= 2 * replay.slots
    rows = [r for batch in seen.values() for r in batch]
    orders = [[i for e, _, i in sorted(rows) if e == epoch] for epoch in (0, 1)]
    assert all(sorted(o) == [3 * i for i in range(n)] for o in orders) and len(rows) == 2 * n
    assert n == 1 or orders[0] != orders[1] != sorted(orders[1])
    assert all(len(b) <= 40 for b in seen.values())


def test_goes_on_at_the_offset_and_repeats_exactly(spark, tmp_path):
    replay = Replay.of(_traces(spark, 60), "id", batch_slots=25, epochs=1, path=str(tmp_path / "table"))
    whole: dict = {}
    replay.run(_collect(whole), str(tmp_path / "whole"))
    parts: dict = {}
    assert replay.run(_collect(parts), str(tmp_path / "parts"), batches=1) == 25
    with pytest.raises(Exception):
        Replay(spark, str(tmp_path / "table"), 25, 1).run(lambda *_: 1 / 0, str(tmp_path / "parts"))
    Replay(spark, str(tmp_path / "table"), 25, 1).run(_collect(parts), str(tmp_path / "parts"))
    assert parts == whole and sorted(parts) == [0, 1, 2]
    other: dict = {}
    Replay(spark, str(tmp_path / "table"), 25, 1, seed=7).run(_collect(other), str(tmp_path / "other"))
    assert other != whole


def test_odd_tables(spark, tmp_path):
    """Repeated ids and nulls are rows like others; an empty table gives no rows; clashing names are errors."""
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "id long, name string")
    seen: dict = {}
    Replay.of(rows, "id", 100, epochs=1).run(_collect(seen), str(tmp_path / "odd"))
    assert len(seen[0]) == 3
    none: dict = {}
    Replay.of(rows.limit(0), "id", 100, epochs=1).run(_collect(none), str(tmp_path / "none"))
    assert not any(none.values())
    with pytest.raises(ValueError):
        Replay.of(rows.withColumn("Epoch", F.lit(1)), "id", 10)
    with pytest.raises(ValueError):
        Replay.of(rows, "id", 10).run(_collect(none), str(tmp_path / "endless"))
