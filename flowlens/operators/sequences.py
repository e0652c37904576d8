"""Sequence samples: 3 x 30 tensors and the 45 tabular values that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowlens.functions import sequence as seq
from flowlens.functions.histogram import log_bins, parse_histogram
from flowlens.functions.numeric import log1p_safe
from flowlens.operators.encode import Dictionary
from flowlens.schema import HISTOGRAM_NAMES, HISTOGRAM_SIZE, SEQUENCE_LENGTH

# Fixed value: the largest port number scales ports to 0..1.
MAX_PORT = 65535.0


def parse_text_columns(df: DataFrame) -> DataFrame:
    """PPI and histogram columns from JSON text to arrays; arrays stay as they are."""
    parsers = {"PPI": seq.parse_ppi, **{name: parse_histogram for name in HISTOGRAM_NAMES}}
    texts = {
        name: parse(F.col(name))
        for name, parse in parsers.items()
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType)
    }
    return df.withColumns(texts) if texts else df


def scalar_values(length: int = SEQUENCE_LENGTH) -> list[Column]:
    """The 13 values in front of the histograms."""

    def raw(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    values = [raw("DURATION")]
    for unit in ("BYTES", "PACKETS"):
        forward, reverse = raw(unit), raw(f"{unit}_REV")
        values += [log1p_safe(forward), log1p_safe(reverse), log1p_safe(forward + reverse)]
    values += [raw("PPI_LEN") / float(max(length, 1)), raw("PPI_DURATION"), raw("PPI_ROUNDTRIPS")]
    values += [raw("PROTOCOL"), raw("SRC_PORT") / MAX_PORT, raw("DST_PORT") / MAX_PORT]
    return values


TABULAR_WIDTH = 13 + HISTOGRAM_SIZE * len(HISTOGRAM_NAMES)


def tabular_vector(length: int = SEQUENCE_LENGTH) -> Column:
    """All 45 values as one array; histogram columns must be arrays."""
    return F.concat(F.array(*scalar_values(length)), *[log_bins(F.col(h)) for h in HISTOGRAM_NAMES])


def samples(
    df: DataFrame,
    labels: Dictionary | None,
    versions: Dictionary,
    label: str = "APP",
    keep: Sequence[str] = (),
    length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """Rows of `sequences`, `valid_length`, `tabular`, `version_idx` and, with labels, `label_id`.

    Rows whose label is NULL or unknown are dropped.
    """
    parsed = parse_text_columns(df)
    if labels is not None:
        parsed = labels.encode(parsed, label, "label_id")
    indexed = versions.encode(parsed, "QUIC_VERSION", "version_idx", missing=0)
    return indexed.select(
        *keep,
        seq.tensor(F.col("PPI"), length).alias("sequences"),
        seq.valid_length(F.col("PPI"), length).alias("valid_length"),
        tabular_vector(length).alias("tabular"),
        "version_idx",
        *(["label_id"] if labels is not None else []),
    )


def sequence_only(df: DataFrame) -> DataFrame:
    """Samples with the tabular values and the version blanked out."""
    return df.withColumns(
        {
            "tabular": F.transform("tabular", lambda _: F.lit(0.0)),
            "version_idx": F.lit(0),
        }
    )
