"""Durations, times as text, and code points the engine needs as expressions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import StoreError

UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def duration(text: str) -> timedelta:
    """30d, 6h, 15m or 45s."""
    found = re.fullmatch(r"(\d+)([smhd])", text) if isinstance(text, str) else None
    if not found:
        raise StoreError(f"a duration is a number and s, m, h or d: {text!r}")
    return timedelta(**{UNITS[found[2]]: int(found[1])})


def as_text(column: F.Column, kind: T.DataType) -> F.Column:
    """A value as text: times in ISO 8601 UTC with milliseconds, nested values as JSON, the rest as cast."""
    if isinstance(kind, T.TimestampType):
        column = F.to_utc_timestamp(column, F.current_timezone())
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")
