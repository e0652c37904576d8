"""Data set statistics: counts per service and period, value counts, sampling ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowlens.operators.joins import join_same, settle


def service_rollup(flows: DataFrame, week: str, day: str, label: str) -> DataFrame:
    """Flows per service and day, per day, per week and in total; `level` tells which."""
    return flows.rollup(week, day, label).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("flows")
    )


def value_counts(flows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column in long form, NULL as its own value."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        flows.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))
    )


def sampling_ratio(saved: DataFrame, seen: DataFrame, label: str) -> DataFrame:
    """Per service: saved and seen flows, the kept share and the weight that restores it."""
    kept = saved.groupBy(label).agg(F.count(F.lit(1)).alias("saved"))
    return join_same(seen.select(label, "seen"), kept, [label], "left").select(
        label,
        "seen",
        F.coalesce("saved", F.lit(0)).alias("saved"),
        F.try_divide(F.coalesce("saved", F.lit(0)), F.col("seen")).alias("ratio"),
        F.try_divide(F.col("seen"), F.col("saved")).alias("weight"),
    )


def with_service_weight(flows: DataFrame, ratios: DataFrame, label: str) -> DataFrame:
    """Flows with the weight that brings back the distribution before sampling."""
    side, small = settle(ratios.select(label, "weight"))
    return join_same(flows, side, [label], "left", small=small)
