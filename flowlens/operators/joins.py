"""Joins with small side tables whose size is checked before they are broadcast."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from flowlens.session import checkpointed

# A side table up to this many rows and bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Compute a side table once; also tell whether it is small enough to broadcast.

    The head of the table is as large as the limits allow at most: the row limit follows from the
    width of a row, so that wide rows are not collected in numbers.
    """
    width = max(8, _row_bytes(df.schema))
    rows = max(1, min(max_rows, max_bytes // width))
    head = df.limit(rows + 1).collect()
    if len(head) <= rows:
        return df.sparkSession.createDataFrame(head, _nullable(df.schema)), True
    return checkpointed(df), False


def _row_bytes(kind: T.DataType) -> int:
    """Usual width of a value: 8 bytes for numbers, 20 for text, 16 elements for arrays and maps."""
    if isinstance(kind, T.StructType):
        return sum(_row_bytes(field.dataType) for field in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 16 * _row_bytes(kind.elementType)
    if isinstance(kind, T.MapType):
        return 16 * (_row_bytes(kind.keyType) + _row_bytes(kind.valueType))
    return 20 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def _nullable(schema: T.StructType) -> T.StructType:
    """The same layout with NULL allowed everywhere, as outer joins and windows may produce it."""
    text = schema.json()
    for flag in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{flag}":false', f'"{flag}":true')
    return T.StructType.fromJson(json.loads(text))


def join_same(
    left: DataFrame, right: DataFrame, names: Sequence[str], how: str, small: bool = False
) -> DataFrame:
    """Equi-join in which NULL keys match; the left side's key columns are kept."""
    names = list(names)
    twin = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    condition = F.col(names[0]).eqNullSafe(F.col(f"_r_{names[0]}"))
    for name in names[1:]:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_r_{name}"))
    joined = left.join(F.broadcast(twin) if small else twin, condition, how)
    return joined.drop(*[f"_r_{n}" for n in names])


def lookup(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Left lookup in a side table on a shared column."""
    side, small = settle(table)
    return df.join(F.broadcast(side) if small else side, column, "left")


def input_bytes(df: DataFrame) -> int:
    """Size of the table as the optimizer estimates it from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
