"""Packet sequences: [[inter-packet times], [directions], [sizes]]."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens.functions.numeric import log1p_safe, zero
from flowlens.schema import SEQUENCE_LENGTH


def parse_ppi(text: Column) -> Column:
    """JSON triplet to array<array<double>>; NULL if malformed."""
    return F.from_json(text, "array<array<double>>")


def channel(ppi: Column, index: int) -> Column:
    return F.get(ppi, F.lit(index))


def pad(values: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """Cut to `length` or fill up with zeros; a NULL list is all zeros."""
    return F.transform(_stretch(values, length), lambda x: F.coalesce(x, zero()))


def _stretch(values: Column, length: int) -> Column:
    filler = F.array_repeat(zero(), length)
    return F.slice(F.concat(F.coalesce(values, filler), filler), 1, length)


def log_times(values: Column) -> Column:
    return F.transform(values, log1p_safe)


def tensor(ppi: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """Three channels of equal length: log time, direction, size."""
    return F.array(
        log_times(_stretch(channel(ppi, 0), length)),
        pad(channel(ppi, 1), length),
        pad(channel(ppi, 2), length),
    )


def valid_length(ppi: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """Number of real packets in the padded sequence."""
    return F.least(ppi_length(ppi), F.lit(length))


def ppi_length(ppi: Column) -> Column:
    return F.coalesce(F.size(channel(ppi, 0)), F.lit(0))


def ppi_duration(ppi: Column, units_per_second: float = 1000.0) -> Column:
    """Sum of the inter-packet times in seconds."""
    total = F.aggregate(
        F.coalesce(channel(ppi, 0), F.array(zero())), zero(), lambda s, x: s + F.coalesce(x, zero())
    )
    return total / units_per_second


def direction_changes(directions: Column) -> Column:
    """How often the direction flips along the list."""
    shifted = F.slice(directions, 2, F.greatest(F.size(directions) - 1, F.lit(0)))
    flips = F.zip_with(directions, shifted, lambda a, b: a != b)
    return F.coalesce(F.size(F.filter(flips, lambda flip: flip)), F.lit(0))


def conform(vector: Column, width: int) -> Column:
    """A vector padded or cut to the expected width."""
    return pad(vector, width)


def has_shape(sequences: Column, channels: int = 3, length: int = SEQUENCE_LENGTH) -> Column:
    """True for exactly `channels` lists of `length` values each."""
    even = F.forall(sequences, lambda row: F.coalesce(F.size(row) == length, F.lit(False)))
    return F.coalesce((F.size(sequences) == channels) & even, F.lit(False))
