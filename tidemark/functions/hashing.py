"""Spark's ``xxhash64`` of key values on the driver, so that a point read needs no job to find its cell."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timezone

import xxhash
from pyspark.sql import types as T

_EPOCH = datetime(1970, 1, 1)


def _bytes(value: object, kind: T.DataType) -> bytes:
    if isinstance(kind, T.LongType):
        return int(value).to_bytes(8, "little", signed=True)  # type: ignore[call-overload]
    if isinstance(kind, T.IntegerType):
        return int(value).to_bytes(4, "little", signed=True)  # type: ignore[call-overload]
    if isinstance(kind, T.DateType):
        return (value - date(1970, 1, 1)).days.to_bytes(4, "little", signed=True)  # type: ignore[operator]
    if isinstance(kind, T.TimestampNTZType):
        gap = value.replace(tzinfo=None) - _EPOCH  # type: ignore[attr-defined]
        return ((gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds).to_bytes(8, "little", signed=True)
    return str(value).encode()


def xxhash64(values: Iterable[tuple[object, T.DataType]], seed: int = 42) -> int:
    """As ``F.xxhash64`` of columns that hold these values, none null: each column's hash is the next one's seed."""
    for v, kind in values:
        seed = xxhash.xxh64_intdigest(_bytes(v, kind), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def cast(value: object, kind: T.DataType) -> object | None:
    """``value`` as a value of ``kind``; None where only Spark's own cast knows."""
    if isinstance(kind, (T.IntegerType, T.LongType)):
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << bits) <= value < 1 << bits else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else None
    if isinstance(kind, T.DateType):
        return value if isinstance(value, date) and not isinstance(value, datetime) else None
    return value if isinstance(value, datetime) and value.tzinfo in (None, timezone.utc) else None
