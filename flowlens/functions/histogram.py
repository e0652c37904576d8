"""Eight-bin packet histograms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens.functions.numeric import log1p_safe
from flowlens.schema import HISTOGRAM_SIZE, HISTOGRAM_UPPER_EDGES


def bin_index(value: str) -> Column:
    """Bin of a column of sizes in bytes or times in milliseconds."""
    steps = " ".join(f"WHEN floor({value}) <= {e} THEN {i}" for i, e in enumerate(HISTOGRAM_UPPER_EDGES))
    return F.expr(f"CASE {steps} WHEN {value} IS NOT NULL THEN {len(HISTOGRAM_UPPER_EDGES)} END")


def parse_histogram(text: Column) -> Column:
    """JSON text to array<double>; NULL if malformed."""
    return F.from_json(text, "array<double>")


def _zeros() -> Column:
    return F.array_repeat(F.lit(0.0), HISTOGRAM_SIZE)


def fixed_bins(bins: Column) -> Column:
    """First eight bins, or zeros when fewer are present."""
    return F.when(F.size(bins) >= HISTOGRAM_SIZE, F.slice(bins, 1, HISTOGRAM_SIZE)).otherwise(
        _zeros()
    )


def log_bins(bins: Column) -> Column:
    """log1p of the first eight bins, missing ones as 0."""
    kept = F.slice(F.concat(F.coalesce(bins, _zeros()), _zeros()), 1, HISTOGRAM_SIZE)
    return F.transform(kept, log1p_safe)
