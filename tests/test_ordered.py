"""Hot keys cut into ranges give the same rows as plain windows."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics, packets as pk, sampling
from flowlens.operators.ordered import OrderedRows
from flowlens.plans import views as v

IDLE = v.IDLE_US


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """Packets in which one key holds half of all rows, one key is NULL and times repeat."""
    rows = v.packets(spark, sf)
    key = F.when(F.col("packet_id") % 2 == 0, F.lit(7)).when(F.col("packet_id") % 9 == 1, F.lit(None)).otherwise(
        F.col("flow_key")
    )
    stamp = F.when(F.col("packet_id") % 5 == 0, F.lit(1704300000000000)).otherwise(F.col("ts_us"))
    return rows.select("packet_id", key.alias("flow_key"), stamp.alias("ts_us"), "direction", "size").cache()


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a = sorted(map(repr, left.select(columns).collect()))
    b = sorted(map(repr, right.select(columns).collect()))
    assert a == b
    assert a


def test_hot_key_is_split(skewed):
    rows = OrderedRows.of(skewed, ["flow_key"], pk.ORDER, rows_per_task=50)
    assert rows._hot is not None
    spread = rows._hot.filter("flow_key = 7").select("_range").distinct().count()
    assert spread >= 5
    largest = rows._hot.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest <= 200


def test_gaps(skewed):
    same(pk.packet_gaps(skewed, ["flow_key"], 1, rows_per_task=40), pk.packet_gaps(skewed, ["flow_key"], 1))


@pytest.mark.parametrize("active", [None, 72 * v.HOUR_US])
def test_flows(skewed, active):
    plain = pk.label_flows(skewed, ["flow_key"], IDLE, active, 1000)
    cut = pk.label_flows(skewed, ["flow_key"], IDLE, active, 1000, rows_per_task=40)
    same(plain, cut)
    end = F.lit(1706659200000000)
    same(pk.assemble_flows(plain, ["flow_key"], IDLE, end), pk.assemble_flows(cut, ["flow_key"], IDLE, end))


def test_windows(skewed):
    same(pk.count_windows(skewed, ["flow_key"], 7), pk.count_windows(skewed, ["flow_key"], 7, rows_per_task=40))


def test_running_accuracy(spark, sf):
    scored = v.predictions(spark, sf).withColumn("day", F.lit("one"))
    order = ["first_us", "head_id"]
    same(metrics.running_accuracy(scored, "day", order, 3), metrics.running_accuracy(scored, "day", order, 3, 20))


def test_all_keys_below_cut(skewed):
    assert OrderedRows.of(skewed, ["flow_key"], pk.ORDER, rows_per_task=100_000)._hot is None


def test_empty_table(skewed):
    empty = skewed.limit(0)
    assert pk.count_windows(empty, ["flow_key"], rows_per_task=10).count() == 0
    assert pk.label_flows(empty, ["flow_key"], IDLE).count() == 0


def test_smallest_of_a_heavy_class(spark):
    rows = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "rare").otherwise("big").alias("label")
    )
    split = sampling.stratified_split(rows, "label", "id", 0.2)
    counts = {(r[0], r[1]): r[2] for r in split.groupBy("label", "is_validation").count().collect()}
    assert counts[("rare", True)] == round(0.2 * 1667)
    assert counts[("big", True)] == round(0.2 * 3333)
    assert sum(counts.values()) == 5000


def test_sample_with_tied_scores(spark):
    rows = spark.range(1000)
    picked = sampling.sample_rows(rows, 137, "id", score=F.col("id") % 3)
    assert picked.count() == 137
    assert picked.filter("id % 3 = 0").count() == 137


def test_sample_within_one_bucket(spark):
    """Scores that share their top bits are told apart by the rest, ties by the id."""
    score = F.lit(5 << 20) + (F.col("id") * 37 % 500)
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    picked = sampling.sample_rows(rows, 141, "id", score=score).collect()
    order = sorted(range(1000), key=lambda i: (i * 37 % 500, i))
    assert sorted(r["id"] for r in picked) == sorted(order[:141])
    split = sampling.stratified_split(rows, "g", "id", 0.25, score=score)
    for g in range(3):
        members = [i for i in order if i % 3 == g]
        want = sorted(members[: round(0.25 * len(members))])
        assert sorted(r["id"] for r in split.filter(f"g = {g} and is_validation").collect()) == want


def test_sample_larger_than_table(spark):
    assert sampling.sample_rows(spark.range(10), 50, "id").count() == 10
    assert sampling.sample_rows(spark.range(10), 0, "id").count() == 0
    assert sampling.sample_rows(spark.range(0), 5, "id").count() == 0


def test_every_key_above_the_limit_is_split(spark):
    """Many hot keys at once: the limit does not grow with the table, and results stay those of plain windows."""
    rows = spark.range(60 * 90).select((F.col("id") % 60).alias("key"), F.col("id").alias("at"))
    ordered = OrderedRows.of(rows, ["key"], ["at"], 50)
    assert ordered._calm.count() == 0 and ordered._hot.count() == rows.count()
    longest = ordered._hot.groupBy("key", "_range").count().agg(F.max("count")).first()[0]
    assert longest <= 90
    running = ordered.with_running(sums={"n": F.lit(1)}).frame()
    assert running.filter(F.col("n") != F.floor(F.col("at") / 60) + 1).count() == 0
