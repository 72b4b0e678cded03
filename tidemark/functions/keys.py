"""Order-preserving binary keys, as Column expressions.

Each column is a type byte and a payload; comparing the bytes (unsigned) orders
as comparing the tuples. Keys are made by built-in functions alone, inside
generated code.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import BadRequest
from tidemark.shipping import ship

#: The type byte of each kind of key column.
TYPE_BYTES = {
    "bytes": "01", "byte": "03", "short": "04", "int": "05", "long": "06", "timestamp_millis": "07", "timestamp_nanos": "08", "date": "09", "time": "0A",
}


def _flipped(c: Column, bytes_: int) -> Column:
    """Big-endian two's complement with the sign bit flipped, as hex: an unsigned offset from the least value."""
    digits = 2 * bytes_
    if bytes_ == 8:
        return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), digits, "0")
    return F.lpad(F.hex(c.cast("long") + F.lit(1 << (8 * bytes_ - 1))), digits, "0")


def _grouped(c: Column) -> Column:
    """Groups of eight bytes, zero-padded, each followed by 0xFF less its
    padding; a value whose length is a multiple of eight ends in a group of padding."""
    text = F.hex(c)
    whole = F.floor(F.octet_length(c) / 8).cast("int")
    used = F.octet_length(c) % 8
    groups = F.transform(F.sequence(F.lit(0), whole), lambda i: F.when(
        i < whole, F.concat(F.substring(text, i * 16 + 1, F.lit(16)), F.lit("FF"))
    ).otherwise(F.concat(F.rpad(F.substring(text, i * 16 + 1, used * 2), 16, "0"), F.lpad(F.hex((F.lit(0xFF) - (F.lit(8) - used)).cast("long")), 2, "0"))))
    return F.concat_ws("", groups)


def utc(c: Column) -> Column:
    """A timestamp without a zone as an instant, as if it were in UTC, whatever the session's zone and its gaps."""
    return F.concat(c.cast("string"), F.lit("Z")).cast("timestamp")


def encoded(c: Column, kind: T.DataType, time: bool = False, nanos: Column | None = None, millis: bool = False) -> Column:
    """Key bytes of one column. ``time``: an int of milliseconds of the day.
    Timestamps: whole milliseconds with ``millis``, else milliseconds and nanoseconds within (``nanos`` below the microsecond)."""
    if time:
        inside = (c >= 0) & (c < 86_400_000)
        body = F.when(inside, F.lpad(F.hex(c.cast("long")), 8, "0")).otherwise(F.raise_error(F.lit("time of day out of range")).cast("string"))
        return F.unhex(F.concat(F.lit(TYPE_BYTES["time"]), body))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.unhex(F.concat(F.lit(TYPE_BYTES["bytes"]), _grouped(c.cast("binary"))))
    for cls, name, size in ((T.ByteType, "byte", 1), (T.ShortType, "short", 2), (T.IntegerType, "int", 4), (T.LongType, "long", 8)):
        if isinstance(kind, cls):
            return F.unhex(F.concat(F.lit(TYPE_BYTES[name]), _flipped(c, size)))
    if isinstance(kind, T.DateType):
        return F.unhex(F.concat(F.lit(TYPE_BYTES["date"]), _flipped(F.unix_date(c), 4)))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        micros = F.unix_micros(c.cast("timestamp") if isinstance(kind, T.TimestampType) else utc(c))
        within = F.pmod(micros, F.lit(1000))
        ms = ((micros - within) / 1000).cast("long")
        if millis:
            whole = F.when(within == 0, _flipped(ms, 8)).otherwise(F.raise_error(F.lit("timestamp is not whole milliseconds")).cast("string"))
            return F.unhex(F.concat(F.lit(TYPE_BYTES["timestamp_millis"]), whole))
        rest = within * 1000 + (nanos if nanos is not None else F.lit(0))
        return F.unhex(F.concat(F.lit(TYPE_BYTES["timestamp_nanos"]), _flipped(ms, 8), F.lpad(F.hex(rest.cast("long")), 8, "0")))
    raise BadRequest(f"type {kind.simpleString()} cannot be a key")


def encode_key(schema: T.StructType, columns: list[str] | tuple[str, ...]) -> Column:
    """Key bytes of the columns together; those of leading columns are a prefix of a whole key."""
    return F.concat(*(encoded(F.col(c), schema[c].dataType) for c in columns))


def prefix_next(prefix: bytes) -> bytes | None:
    """The least bytes above everything that begins with ``prefix``; None: no bound."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


def decode_key(data: bytes, schema: T.StructType, columns: list[str] | tuple[str, ...]) -> tuple:
    """The values of key bytes, for a prefix of ``columns`` if the bytes end after it. Bytes that no key has are a BadRequest."""
    out: list[object] = []
    at = 0
    try:
        for c in columns:
            if at == len(data):
                break
            value, at = _decoded(data, at, schema[c].dataType)
            out.append(value)
    except (IndexError, ValueError, OverflowError) as e:
        raise BadRequest(f"no key: {e}") from e
    if at != len(data):
        raise BadRequest("bytes are left after the key")
    return tuple(out)


_SIZES = {T.ByteType: ("byte", 1), T.ShortType: ("short", 2), T.IntegerType: ("int", 4), T.LongType: ("long", 8), T.DateType: ("date", 4)}


def _decoded(data: bytes, at: int, kind: T.DataType) -> tuple[object, int]:
    def number(size: int) -> int:
        if at + 1 + size > len(data):
            raise ValueError("it is cut off")
        return int.from_bytes(data[at + 1 : at + 1 + size], "big") - (1 << (8 * size - 1))

    def typed(name: str) -> None:
        if data[at] != int(TYPE_BYTES[name], 16):
            raise ValueError(f"byte {at} is not the type of {name}")

    if isinstance(kind, (T.StringType, T.BinaryType)):
        typed("bytes")
        parts, i = [], at + 1
        while True:
            group, more = data[i : i + 8], 0xFF - data[i + 8]
            if more > 8 or any(group[8 - more :]):
                raise ValueError("a group has a wrong padding")
            parts.append(group[: 8 - more])
            i += 9
            if more:
                raw = b"".join(parts)
                return (raw.decode() if isinstance(kind, T.StringType) else raw), i
    if isinstance(kind, T.TimestampNTZType):
        typed("timestamp_nanos")
        nanos = int.from_bytes(data[at + 9 : at + 13], "big")
        return datetime(1970, 1, 1) + timedelta(milliseconds=number(8), microseconds=nanos // 1000), at + 13
    name, size = _SIZES[type(kind)]
    typed(name)
    value = number(size)
    return (date(1970, 1, 1) + timedelta(days=value) if isinstance(kind, T.DateType) else value), at + 1 + size


def decoded_keys(df: DataFrame, key: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """Key columns of a column of whole keys, by Arrow batches: groups of bytes
    have no bound that an expression could unroll."""
    ship(df.sparkSession)
    own = T.StructType([T.StructField(c, schema[c].dataType) for c in columns])

    @F.pandas_udf(own)
    def decode(keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_key(bytes(k), schema, columns) for k in keys], columns=columns)

    return df.select("*", decode(key).alias("_key")).select(*(F.col(f"_key.{c}").alias(c) for c in columns), *df.columns)
