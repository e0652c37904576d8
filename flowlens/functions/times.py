"""Timestamps written with hyphens in the time part."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: text form of TIME_FIRST and TIME_LAST.
FLOW_TIME_FORMAT = "yyyy-MM-dd'T'HH-mm-ss[.SSSSSS]"


def parse_flow_time(text: Column) -> Column:
    """Hyphenated form first, then any form Spark casts; NULL if neither fits."""
    hyphenated = F.try_to_timestamp(text, F.lit(FLOW_TIME_FORMAT))
    return F.coalesce(hyphenated, text.try_cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    gap = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return F.coalesce(gap, F.lit(0.0))


def start_hour(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(-1))


def minute_of_day(ts: Column) -> Column:
    """Hour times 60 plus minute; -60 for an unknown time."""
    return start_hour(ts) * 60 + F.coalesce(F.minute(ts), F.lit(0))


def day_of_week(ts: Column) -> Column:
    """Monday is 0; -1 for an unknown time."""
    return F.coalesce(F.weekday(ts), F.lit(-1))


def is_weekend(ts: Column) -> Column:
    return (day_of_week(ts) >= 5).cast("int")


def day_from_path(path: Column) -> Column:
    """Day held in a daily file's name, e.g. flows-20221121.csv.gz."""
    digits = F.regexp_extract(path, r"(\d{8})\.(?:csv|parquet)", 1)
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def parquet_name(path: Column) -> Column:
    """Name of the Parquet twin of the CSV file (or folder of CSV parts) in a path."""
    stem = F.regexp_extract(path, r"([^/=]+?)\.(?:csv|parquet)(?:\.gz)?(?:/|$)", 1)
    return F.concat(stem, F.lit(".parquet"))
