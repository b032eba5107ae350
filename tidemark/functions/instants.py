"""Instants as microseconds since 1970 in UTC, whatever the session's time zone is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(df: DataFrame, name: str) -> Column:
    """Of a timestamp column with or without zone (without: UTC)."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{name}`)")


def iso_micros(text: Column) -> Column:
    """Of an ISO string with 'Z', an offset, or neither (UTC); null if it can't be read."""
    zoned = text.rlike("(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)$") & text.rlike(":")
    return F.unix_micros(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp"))


def utc_day(us: Column) -> Column:
    """YYYY-MM-DD of microseconds since 1970."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(86_400_000_000)).cast("int")), "yyyy-MM-dd")


def utc_month(us: Column) -> Column:
    return F.substring(utc_day(us), 1, 7)
