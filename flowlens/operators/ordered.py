"""Row order inside each key, also for keys that hold a large share of all rows.

Keys of ordinary size use plain windows: one shuffle on the key. A key with more rows
than one task should sort is range-partitioned on (key, order), so its rows spread over
many tasks; each range is scanned on its own and the few range totals are carried over.
Hot keys and carry tables (one row per range and hot key) are broadcast only below a size limit
and joined by shuffle beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.operators.joins import join_same, settle
from flowlens.session import checkpointed

# Every key with more rows than this is split, whatever the size of the table.
ROWS_PER_TASK = 4_000_000
RANGE = "_range"


class OrderedRows:
    """A table with a total order inside each key.

    `order` must end in a column that is unique inside the key.
    """

    def __init__(self, calm: DataFrame, hot: DataFrame | None, keys: list[str], order: list[str]):
        self._calm = calm
        self._hot = hot
        self._keys = keys
        self._order = order

    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        rows_per_task: int = ROWS_PER_TASK,
    ) -> "OrderedRows":
        keys, order = list(keys), list(order)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_task)
        hot_sizes, small = settle(sizes)
        hot_rows = hot_sizes.agg(F.sum("_rows")).first()[0]
        if hot_rows is None:
            return cls(df, None, keys, order)
        hot_keys = hot_sizes.drop("_rows")
        ranges = math.ceil(hot_rows / rows_per_task)
        hot = (
            join_same(df, hot_keys, keys, "left_semi", small=small)
            .repartitionByRange(ranges, *keys, *order)
            .withColumn(RANGE, F.spark_partition_id())
        )
        calm = join_same(df, hot_keys, keys, "left_anti", small=small)
        # The range of a row must not change between uses, hence the written copy.
        return cls(calm, checkpointed(hot), keys, order)

    def _window(self, hot: bool):
        extra = [RANGE] if hot else []
        return Window.partitionBy(*self._keys, *extra).orderBy(*self._order)

    def _with(self, calm: DataFrame, hot: DataFrame | None) -> "OrderedRows":
        return OrderedRows(calm, hot, self._keys, self._order)

    def _carried(self, name: str, total: Column, over: Callable[[Window], Column]) -> DataFrame:
        """Hot rows plus `over` evaluated on the range totals, as column `name`.

        The totals, one row per range and key, are computed at once: otherwise every
        later step would repeat all earlier ones.
        """
        totals = self._hot.groupBy(*self._keys, RANGE).agg(total.alias("_total"))
        ranges = Window.partitionBy(*self._keys).orderBy(RANGE)
        carry, small = settle(totals.select(*self._keys, RANGE, over(ranges).alias(name)))
        return join_same(self._hot, carry, [*self._keys, RANGE], "left", small=small)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> "OrderedRows":
        """Row-wise change that keeps keys and order columns."""
        return self._with(change(self._calm), change(self._hot) if self._hot is not None else None)

    def with_neighbours(
        self, previous: dict[str, str] | None = None, following: dict[str, str] | None = None
    ) -> "OrderedRows":
        """Columns of the row before and the row after, as {new name: column}."""
        sides = [(previous or {}, F.lag, F.max_by), (following or {}, F.lead, F.min_by)]
        window = self._window(False)
        calm = self._calm.withColumns(
            {new: shift(F.col(old)).over(window) for names, shift, _ in sides for new, old in names.items()}
        )
        hot = self._hot
        if hot is not None:
            used = [(names, shift, edge, f"_edge{i}") for i, (names, shift, edge) in enumerate(sides) if names]
            packed = {
                at: F.struct(*[F.col(old).alias(new) for new, old in names.items()]) for names, _, _, at in used
            }
            edges = F.struct(*[edge(packed[at], F.struct(*self._order)).alias(at) for _, _, edge, at in used])

            def across(ranges) -> Column:
                return F.struct(*[shift(F.col("_total")[at]).over(ranges).alias(at) for _, shift, _, at in used])

            hot = self._carried("_edges", edges, across)
            inner = {at: shift(packed[at]).over(self._window(True)) for _, shift, _, at in used}
            hot = hot.withColumns({at: F.coalesce(inner[at], F.col("_edges")[at]) for at in inner})
            hot = hot.withColumns({new: F.col(at)[new] for names, _, _, at in used for new in names})
            hot = hot.drop("_edges", *inner)
        return self._with(calm, hot)

    def with_running(
        self, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None
    ) -> "OrderedRows":
        """Running sums and maxima up to and including each row."""
        asked = [(n, c, F.sum) for n, c in (sums or {}).items()]
        asked += [(n, c, F.max) for n, c in (maxima or {}).items()]

        def locally(df: DataFrame, hot: bool) -> DataFrame:
            rows = self._window(hot).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return df.withColumns({name: total(value).over(rows) for name, value, total in asked})

        calm = locally(self._calm, False)
        hot = self._hot
        if hot is not None:
            totals = F.struct(*[total(value).alias(name) for name, value, total in asked])

            def before(ranges) -> Column:
                earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
                return F.struct(
                    *[total(F.col("_total")[name]).over(earlier).alias(name) for name, _, total in asked]
                )

            hot = locally(self._carried("_before", totals, before), True)
            merged = {}
            for name, _, total in asked:
                earlier = F.col("_before")[name]
                if total is F.sum:
                    merged[name] = F.col(name) + F.coalesce(earlier, F.lit(0))
                else:
                    merged[name] = F.greatest(F.col(name), earlier)
            hot = hot.withColumns(merged).drop("_before")
        return self._with(calm, hot)

    def frame(self) -> DataFrame:
        if self._hot is None:
            return self._calm
        return self._calm.unionByName(self._hot.drop(RANGE))
