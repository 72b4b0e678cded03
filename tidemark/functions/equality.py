"""Equality that is true only as SQL TRUE, also inside of nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def equal(a: Column, b: Column, kind: T.DataType) -> Column:
    """True or false, never null. Nulls match nothing, at any depth; NaN does
    not match NaN; 0.0 matches -0.0; maps match by key, in any order."""
    return F.coalesce(_equal(a, b, kind), F.lit(False))


def _equal(a: Column, b: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (a == b) & ~F.isnan(a)
    if isinstance(kind, T.StructType):
        out = a.isNotNull() & b.isNotNull()
        for f in kind.fields:
            out = out & equal(a.getField(f.name), b.getField(f.name), f.dataType)
        return out
    if isinstance(kind, T.ArrayType):
        pairs = F.zip_with(a, b, lambda x, y: equal(x, y, kind.elementType))
        return (F.size(a) == F.size(b)) & a.isNotNull() & b.isNotNull() & F.forall(pairs, lambda x: x)
    if isinstance(kind, T.MapType):
        each = F.forall(F.map_entries(a), lambda e: F.map_contains_key(b, e["key"]) & equal(e["value"], F.element_at(b, e["key"]), kind.valueType))
        return a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & each
    return a == b
