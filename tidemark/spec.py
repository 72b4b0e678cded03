"""Table specification: schema, primary key, partitioning and buckets."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BadRequest, SchemaMismatch

#: Types that a value column may have; arrays, maps and structs of them too.
VALUE_TYPES = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType,
    T.BinaryType, T.DateType, T.TimestampNTZType, T.TimestampType,
)
#: Types that a primary key column may have.
KEY_TYPES = (T.IntegerType, T.LongType, T.StringType, T.DateType, T.TimestampNTZType)
RESERVED = ("_seq", "_deleted", "_bucket", "_kind", "_op")


#: Types by their SQL names, for schemas that are made before there is a session.
NAMED = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def columns(**kinds: str) -> T.StructType:
    """A schema from names and simple types, such as ``columns(id="bigint")``."""
    return T.StructType([T.StructField(c, NAMED[k]) for c, k in kinds.items()])


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere inside, as files are read."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    return kind


def _check_value(kind: T.DataType, where: str) -> None:
    if isinstance(kind, T.ArrayType):
        _check_value(kind.elementType, where)
    elif isinstance(kind, T.MapType):
        _check_value(kind.keyType, where)
        _check_value(kind.valueType, where)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            _check_value(f.dataType, f"{where}.{f.name}")
    elif not isinstance(kind, VALUE_TYPES):
        raise BadRequest(f"{where}: type {kind.simpleString()} is not supported")


@dataclass(frozen=True)
class TableSpec:
    """The fixed schema of a current-state table. Partition columns are part of
    the primary key, so that a key never moves between partitions."""

    schema: T.StructType
    primary_key: tuple[str, ...]
    partition_by: tuple[str, ...] = ()
    buckets: int = 1

    def __post_init__(self) -> None:
        object.__setattr__(self, "primary_key", tuple(self.primary_key))
        object.__setattr__(self, "partition_by", tuple(self.partition_by))
        names = self.schema.fieldNames()
        if not self.primary_key:
            raise BadRequest("a primary key is needed")
        if len(set(names)) != len(names) or len(set(self.primary_key)) != len(self.primary_key):
            raise BadRequest("column names must differ")
        for c in (*self.primary_key, *self.partition_by):
            if c not in names:
                raise BadRequest(f"no column {c}")
        if not set(self.partition_by) <= set(self.primary_key):
            raise BadRequest("partition columns must be part of the primary key")
        if self.buckets < 1:
            raise BadRequest("buckets must be positive")
        for f in self.schema.fields:
            if f.name in RESERVED:
                raise BadRequest(f"column name {f.name} is reserved")
            _check_value(f.dataType, f.name)
            if f.name in self.primary_key and not isinstance(f.dataType, KEY_TYPES):
                raise BadRequest(f"{f.name}: type {f.dataType.simpleString()} cannot be a key")
        key = set(self.primary_key)
        fixed = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in key) for f in self.schema.fields])
        object.__setattr__(self, "schema", fixed)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.primary_key]

    @property
    def bucket_by(self) -> list[str]:
        """The key columns that choose a row's bucket: those that do not choose its partition."""
        return [c for c in self.primary_key if c not in self.partition_by] or list(self.primary_key)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def stored(self) -> T.StructType:
        """Schema of changelog batches and runs: deletes carry only the key."""
        key = set(self.primary_key)
        fields = [T.StructField(f.name, nullable(f.dataType), f.name not in key) for f in self.schema.fields]
        return T.StructType([*fields, T.StructField("_seq", T.LongType(), False), T.StructField("_deleted", T.BooleanType(), False)])

    def to_json(self) -> dict:
        return {
            "schema": json.loads(self.schema.json()), "primary_key": list(self.primary_key), "partition_by": list(self.partition_by), "buckets": self.buckets,
        }

    @classmethod
    def from_json(cls, d: dict) -> TableSpec:
        return cls(T.StructType.fromJson(d["schema"]), tuple(d["primary_key"]), tuple(d["partition_by"]), d["buckets"])

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.to_json(), sort_keys=True).encode()).hexdigest()

    def check_same(self, other: TableSpec) -> None:
        """Same columns in the same order with the same types, nullability and key, or SchemaMismatch says what differs."""
        a, b = self.schema.fields, other.schema.fields
        if [f.name for f in a] != [f.name for f in b]:
            raise SchemaMismatch(f"columns differ: {[f.name for f in a]} and {[f.name for f in b]}")
        for x, y in zip(a, b, strict=True):
            if x.dataType != y.dataType or x.nullable != y.nullable:
                raise SchemaMismatch(f"column {x.name} differs: {x.simpleString()} and {y.simpleString()}")
        if self.primary_key != other.primary_key:
            raise SchemaMismatch("the order or columns of the primary keys differ")
