"""Null-safe arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def zero() -> Column:
    return F.lit(0.0)


def number(value: Column) -> Column:
    """Value as double; NULL, NaN and text that is no number become 0."""
    return F.coalesce(F.nanvl(value.try_cast("double"), zero()), zero())


def number_sql(name: str, alias: str | None = None) -> str:
    """`number` of a column as SQL text, for long select lists."""
    return f"coalesce(nanvl(try_cast(`{name}` AS double), 0D), 0D) AS `{alias or name}`"


def log1p_safe(value: Column) -> Column:
    """ln(1 + x) with NULL and negative values taken as 0."""
    # greatest skips NULL.
    return F.log1p(F.greatest(value, zero()))


def per(amount: Column, base: Column) -> Column:
    """amount / base, 0 where the base is not positive."""
    return F.when(base > 0, amount / base).otherwise(zero())


def smoothed_ratio(forward: Column, reverse: Column) -> Column:
    return F.coalesce(F.try_divide(forward + 1.0, reverse + 1.0), zero())


def balance(forward: Column, reverse: Column) -> Column:
    """(forward - reverse) over their sum, 0 for two zeros."""
    total = forward + reverse
    return (forward - reverse) / F.when(total == 0, F.lit(1.0)).otherwise(total)


def hash32(*values: Column, seed: int = 42) -> Column:
    """Uniform integer in [0, 2^32) that depends only on the values and the seed."""
    return F.shiftrightunsigned(F.xxhash64(*values, F.lit(seed)), 32)
