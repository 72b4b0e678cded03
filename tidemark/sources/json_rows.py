"""JSON rows: dates as days, timestamps as milliseconds, binary as base64, decimals as plain strings."""

from __future__ import annotations

import base64
from collections.abc import Mapping
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import BadRequest, NotSupported
from tidemark.functions.keys import utc
from tidemark.spec import TableSpec

_DAY, _EPOCH = date(1970, 1, 1), datetime(1970, 1, 1)


def from_json(spec: TableSpec, row: Mapping, columns: list[str] | None = None) -> dict:
    """A row of the table's types; missing and null columns are None, others are ignored."""
    return {c: _in(spec.schema[c].dataType, row[c], c) for c in (columns or spec.columns) if row.get(c) is not None} | {
        c: None for c in (columns or spec.columns) if row.get(c) is None
    }


def _in(kind: T.DataType, v: object, name: str) -> object:
    try:
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise NotSupported(f"{name}: nested values have no JSON form here")
        if isinstance(kind, T.BooleanType):
            if not isinstance(v, bool):
                raise TypeError
            return v
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            if isinstance(v, bool) or int(v) != v:  # type: ignore[call-overload]
                raise TypeError
            return int(v)  # type: ignore[call-overload]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(v)  # type: ignore[arg-type]
        if isinstance(kind, T.DecimalType):
            return Decimal(str(v))
        if isinstance(kind, T.DateType):
            return _DAY + timedelta(days=v)  # type: ignore[arg-type]
        if isinstance(kind, T.TimestampNTZType):
            return _EPOCH + timedelta(milliseconds=v)  # type: ignore[arg-type]
        if isinstance(kind, T.TimestampType):
            return _EPOCH.replace(tzinfo=timezone.utc) + timedelta(milliseconds=v)  # type: ignore[arg-type]
        if isinstance(kind, T.BinaryType):
            return base64.b64decode(v, validate=True)  # type: ignore[arg-type]
        return str(v)
    except (TypeError, ValueError, InvalidOperation, OverflowError) as e:
        raise BadRequest(f"{name}: {v!r} is no {kind.simpleString()}") from e


def to_json(spec: TableSpec, row: Mapping) -> dict:
    return {c: None if row[c] is None else _out(spec.schema[c].dataType, row[c], c) for c in row if c in spec.columns}


def _out(kind: T.DataType, v, name: str) -> object:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise NotSupported(f"{name}: nested values have no JSON form here")
    if isinstance(kind, T.DateType):
        return (v - _DAY).days
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return (v.replace(tzinfo=None) - _EPOCH) // timedelta(milliseconds=1)
    if isinstance(kind, T.BinaryType):
        return base64.b64encode(bytes(v)).decode()
    if isinstance(kind, T.DecimalType):
        return format(v, "f")
    return v


def json_column(df: DataFrame, spec: TableSpec, name: str = "json") -> DataFrame:
    """The same form for whole DataFrames, by built-in functions."""
    cols = []
    for f in spec.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.unix_date(c)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_millis(c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.unix_millis(utc(c))
        elif isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.withColumn(name, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
