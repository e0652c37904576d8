"""The tabular feature table: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowlens.functions import times
from flowlens.functions.histogram import fixed_bins, parse_histogram
from flowlens.functions.numeric import balance, log1p_safe, number_sql, per, smoothed_ratio
from flowlens.operators.encode import Dictionary
from flowlens.schema import (
    DERIVED_FEATURES,
    FEATURE_COLUMNS,
    HISTOGRAM_NAMES,
    HISTOGRAM_SIZE,
    LABEL,
)


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def default_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that are absent become 0."""
    absent = {c: F.lit(0.0) for c in columns if c not in df.columns}
    return df.withColumns(absent) if absent else df


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; values that are no numbers become 0."""
    return df.selectExpr(*[number_sql(c) if c in columns else f"`{c}`" for c in df.columns])


def with_label(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """Asked columns plus the label, rows without a label dropped."""
    return df.select(*dict.fromkeys([*columns, label])).filter(F.col(label).isNotNull())


def expand_histograms(df: DataFrame) -> DataFrame:
    """Histogram columns, as text or arrays, to eight number columns each; absent ones to zeros."""
    present = [c for c in HISTOGRAM_NAMES if c in df.columns]
    texts = {c: parse_histogram(F.col(c)) for c in present if _is_text(df, c)}
    parsed = df.withColumns(texts) if texts else df
    parsed = parsed.withColumns({c: fixed_bins(F.col(c)) for c in present}) if present else parsed
    rest = [c for c in parsed.columns if c not in present]
    bins = [
        f"coalesce(nanvl(get(`{c}`, {i}), 0D), 0D) AS `{c}_BIN_{i}`"
        for c in present
        for i in range(HISTOGRAM_SIZE)
    ]
    return parsed.selectExpr(*[f"`{c}`" for c in rest], *bins)


def volume_features() -> dict[str, Column]:
    """Features of the byte and packet counters and the packet sequence summary."""

    def raw(name: str) -> Column:
        return F.col(name).cast("double")

    columns = {}
    for unit in ("BYTES", "PACKETS"):
        forward, reverse = raw(unit), raw(f"{unit}_REV")
        total = forward + reverse
        columns[f"TOTAL_{unit}"] = total
        columns[f"{unit}_RATIO"] = smoothed_ratio(forward, reverse)
        columns[f"{unit}_BALANCE"] = balance(forward, reverse)
        columns[f"{unit}_PER_SECOND"] = per(total, raw("DURATION"))
        columns[f"LOG_TOTAL_{unit}"] = log1p_safe(total)
    for end, suffix in (("FWD", ""), ("REV", "_REV")):
        packets = raw(f"PACKETS{suffix}")
        mean = F.try_divide(raw(f"BYTES{suffix}"), packets)
        columns[f"MEAN_PACKET_SIZE_{end}"] = F.coalesce(mean, F.lit(0.0))
    columns["PPI_DENSITY"] = per(raw("PPI_LEN"), raw("PPI_DURATION"))
    columns["PPI_ROUNDTRIP_RATIO"] = per(raw("PPI_ROUNDTRIPS"), raw("PPI_LEN"))
    return columns


def time_features(start: Column, end: Column) -> dict[str, Column]:
    return {
        "START_HOUR": times.start_hour(start),
        "START_MINUTE_OF_DAY": times.minute_of_day(start),
        "START_DAY_OF_WEEK": times.day_of_week(start),
        "IS_WEEKEND": times.is_weekend(start),
        "DURATION_FROM_TIMESTAMPS": times.seconds_between(start, end),
    }


def _with_times(df: DataFrame) -> DataFrame:
    """Time columns as timestamps in `_start` and `_end`; absent ones are NULL."""
    parsed = {}
    for source, target in (("TIME_FIRST", "_start"), ("TIME_LAST", "_end")):
        if source not in df.columns:
            parsed[target] = F.lit(None).cast("timestamp")
        elif _is_text(df, source):
            parsed[target] = times.parse_flow_time(F.col(source))
        else:
            parsed[target] = F.col(source).cast("timestamp")
    return df.withColumns(parsed)


def version_hash(version: Column) -> Column:
    """Stable code of a version without a dictionary; NULL counts as a version."""
    return F.hash(F.coalesce(version.cast("string"), F.lit("UNKNOWN")))


def engineer(df: DataFrame, versions: Dictionary | None = None) -> DataFrame:
    """All derived features next to the input columns.

    With `versions` the version code is the dictionary index (0 for NULL or unseen),
    without it a hash of the version.
    """
    result = _with_times(expand_histograms(df))
    result = result.withColumns({**volume_features(), **time_features(F.col("_start"), F.col("_end"))})
    result = result.drop("_start", "_end")
    if "QUIC_VERSION" not in df.columns:
        return result
    if versions is None:
        return result.withColumn("QUIC_VERSION_CODE", version_hash(F.col("QUIC_VERSION")))
    return versions.encode(result, "QUIC_VERSION", "QUIC_VERSION_CODE", missing=0)


def feature_table(
    df: DataFrame,
    versions: Dictionary | None = None,
    features: Sequence[str] = FEATURE_COLUMNS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Kept columns followed by the features in their fixed order, all as doubles."""
    filled = default_fill(engineer(df, versions), features)
    return filled.selectExpr(*keep, *[number_sql(c) for c in features if c not in keep])


def derived_only(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A few derived features of the counters; the rest of the projection is pruned."""
    wanted = [n for n in names if n in DERIVED_FEATURES]
    columns = volume_features()
    return df.select(*keep, *[columns[n].alias(n) for n in wanted])
