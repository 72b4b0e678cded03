"""Point, prefix and range reads, bulk lookups and the processing-time lookup join."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import BadRequest, NotSupported, Overloaded
from tidemark.functions.equality import equal
from tidemark.plans.merge import live, tristate
from tidemark.spec import TableSpec

from .table import Table


def key_predicate(spec: TableSpec, key: Mapping, whole: bool = True) -> Column:
    """Equalities on the whole key, or on leading key columns without a gap."""
    if unknown := set(key) - set(spec.primary_key):
        raise BadRequest(f"not key columns: {sorted(unknown)}")
    lead = spec.primary_key[: len(key)]
    if whole and len(key) != len(spec.primary_key) or not key:
        raise BadRequest("the whole key is needed" if whole else "a prefix needs one leading key column at least")
    if set(key) != set(lead):
        raise BadRequest(f"a prefix must be leading key columns: {list(lead)}")
    if any(v is None for v in key.values()):
        raise BadRequest("key values must not be null")
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(key[c]).cast(spec.schema[c].dataType) for c in lead))


def _projected(t: Table, columns: Iterable[str] | None) -> list[str]:
    columns = list(t.spec.columns if columns is None else columns)
    if missing := [c for c in columns if c not in t.spec.columns]:
        raise BadRequest(f"no such columns: {missing}")
    return columns


def get_local(t: Table, key: Mapping) -> tuple[str, Row | None]:
    """HIT with the row, DELETED or MISS, from the hot tier alone."""
    with t.metrics.timed("get_local"):
        where = key_predicate(t.spec, key)
        rows = t.checked(lambda: t.hot(where=where, first=_first(t.spec, key))) if t.runs_within(_first(t.spec, key)) else []
    if not rows:
        return "MISS", None
    return ("DELETED", None) if rows[0]["_deleted"] else ("HIT", Row(**{c: rows[0][c] for c in t.spec.columns}))


def _first(spec: TableSpec, key: Mapping) -> tuple[object, object]:
    """Bounds of the first key column."""
    v = key.get(spec.primary_key[0])
    return v, v


def get(t: Table, key: Mapping, columns: Iterable[str] | None = None) -> Row | None:
    """The current row of a key. Only runs whose keys may hold it are read, then its
    cell of the base, and only if the hot tier has no change of it."""
    columns = _projected(t, columns)
    where, first = key_predicate(t.spec, key), _first(t.spec, key)
    with t.metrics.timed("get"):
        if t.runs_within(first):
            rows = t.checked(lambda: t.hot(columns, where, first))
            if rows:
                return None if rows[0]["_deleted"] else Row(**{c: rows[0][c] for c in columns})
        cell = t.cell_of(key)
        if cell not in t.m.base:
            return None
        t.touch([cell])
        rows = t.checked(lambda: t.base([cell], columns).where(where).select(*columns))
    return rows[0] if rows else None


def prefix_local(t: Table, key: Mapping, limit: float | None = None) -> list[Row]:
    """Live hot rows whose leading key columns have these values, in key order.
    More than ``limit`` of them is an error: no part of them is returned. ``math.inf`` is no limit."""
    return _bounded(t, live(t.hot(where=key_predicate(t.spec, key, whole=False), first=_first(t.spec, key))).select(*t.spec.columns), limit)


def prefix(t: Table, key: Mapping, limit: int | None = None, columns: Iterable[str] | None = None) -> list[Row]:
    """The same over all tiers."""
    own = _projected(t, columns)
    df = t.current(dict.fromkeys([*t.spec.primary_key, *own]), key_predicate(t.spec, key, whole=False), t.cells_below(key), _first(t.spec, key))
    return _bounded(t, df, limit, own)


def _bounded(t: Table, df: DataFrame, limit: float | None, columns: list[str] | None = None) -> list[Row]:
    limit = t.options.max_prefix_results if limit is None else limit
    ordered = df.orderBy(*t.spec.primary_key)
    rows = t.checked(lambda: (ordered if limit == math.inf else ordered.limit(limit + 1)).select(*(columns or df.columns)))
    if len(rows) > limit:
        raise Overloaded(f"more than {limit} rows")
    return rows


def scan(t: Table, start: Mapping | None = None, end: Mapping | None = None, columns: Iterable[str] | None = None, local: bool = False) -> DataFrame:
    """Current rows (of the hot tier alone with ``local``) from ``start``, included,
    to ``end``, excluded, both leading key columns, in key order. An empty range has no rows."""
    columns = _projected(t, columns)
    where = None
    for bound, above in ((start, True), (end, False)):
        if bound:
            c = _compared(t.spec, bound, above)
            where = c if where is None else where & c
    wide = list(dict.fromkeys([*t.spec.primary_key, *columns]))
    lead = t.spec.primary_key[0]
    first = ((start or {}).get(lead), (end or {}).get(lead))
    df = live(t.hot(wide, where, first)).select(*wide) if local else t.current(wide, where, first=first)
    return df.orderBy(*t.spec.primary_key).select(*columns)


def _compared(spec: TableSpec, bound: Mapping, at_least: bool) -> Column:
    """Tuple comparison with leading key columns: at least ``bound``, or below it."""
    lead = spec.primary_key[: len(bound)]
    if set(bound) != set(lead):
        raise BadRequest(f"a bound must be leading key columns: {list(lead)}")
    out = F.lit(at_least)
    for c in reversed(lead):
        v = F.lit(bound[c]).cast(spec.schema[c].dataType)
        out = (F.col(c) > v if at_least else F.col(c) < v) | ((F.col(c) == v) & out)
    first = F.lit(bound[lead[0]]).cast(spec.schema[lead[0]].dataType)
    return out & (F.col(lead[0]) >= first if at_least else F.col(lead[0]) <= first)  # a bound on one column reaches the scan


def get_many(t: Table, keys: DataFrame, columns: Iterable[str] | None = None, local: bool = False) -> DataFrame:
    """Each row of ``keys`` with ``result`` (HIT, DELETED or MISS) and the values of hits: one plan for any number of keys.

    With ``local`` from the hot tier; else a hot change is final and other keys
    are looked up in the base, of which only the cells are opened that the keys are
    in (found by a job over the keys). Keys meet the hot tier and then the base, so
    neither is merged with the other; both joins use one partitioning of the keys."""
    own = list(t.spec.primary_key)
    columns = [c for c in _projected(t, columns) if c not in own]
    if missing := [c for c in own if c not in keys.columns]:
        raise BadRequest(f"keys need columns {missing}")
    if clash := [c for c in keys.columns if c in columns or c in ("result", "_deleted", "_there", "_base")]:
        raise BadRequest(f"keys have columns of the result: {clash}")
    hot = t.hot(columns).select(*own, *columns, "_deleted")
    t.metrics.add("get_many")
    if local:
        return tristate(keys, hot, own)
    cells = t.cells_of(keys)
    t.metrics.add("cells_opened", len(cells))
    below = t.base(cells, columns).select(*own, F.struct(F.lit(True).alias("there"), *columns).alias("_base"))
    hot = hot.select(*own, F.struct(F.col("_deleted").alias("gone"), *columns).alias("_there"))
    both = keys.join(hot, own, "left").join(below, own, "left")
    result = F.when(F.col("_there.gone"), "DELETED").when(F.col("_there").isNotNull() | F.col("_base").isNotNull(), "HIT").otherwise("MISS")
    value = lambda c: F.when(F.col("_there").isNull(), F.col(f"_base.{c}")).when(~F.col("_there.gone"), F.col(f"_there.{c}"))
    return both.select(*keys.columns, result.alias("result"), *(value(c).alias(c) for c in columns))


def lookup_join(
    facts: DataFrame, dim: Table | DataFrame, on: Mapping[str, str], how: str = "left", extra: Mapping[str, str] | None = None,
    columns: Iterable[str] | None = None, spec: TableSpec | None = None, suffix: str = "", prune: bool = False,
) -> DataFrame:
    """Each row of ``facts`` with at most one row of the dimension as it is now.

    ``on`` maps fact columns to all key columns of the dimension, in any order;
    ``extra`` maps fact columns to other columns, which must be equal too. Null
    keys match nothing; ``left`` keeps rows without a match, ``inner`` does not.
    Dimension columns are named with ``suffix``. A dimension given as a DataFrame
    needs ``spec``. ``prune``: find the cells of the facts' keys first, by a job over
    the facts, and open no others (for few facts and a large dimension)."""
    if how not in ("left", "inner"):
        raise BadRequest("a lookup join is left or inner")
    spec = dim.spec if isinstance(dim, Table) else spec
    if spec is None:
        raise BadRequest("a dimension that is no table needs a specification")
    extra = dict(extra or {})
    targets = [*on.values(), *extra.values()]
    if any("." in c for c in (*targets, *on, *extra)):
        raise BadRequest("lookup keys must be columns, not fields inside them")
    if len(set(targets)) != len(targets):
        raise BadRequest("a dimension column may be used once")
    if set(on.values()) != set(spec.primary_key):
        raise BadRequest(f"a lookup needs every key column: {list(spec.primary_key)}")
    if missing := [c for c in (*on, *extra) if c not in facts.columns] + [c for c in targets if c not in spec.columns]:
        raise BadRequest(f"no such columns: {missing}")
    shown = list(spec.columns if columns is None else columns)
    wide = list(dict.fromkeys([*spec.primary_key, *extra.values(), *shown]))
    if isinstance(dim, Table):
        asked = facts.select(*(F.col(f).alias(d) for f, d in on.items())).dropna() if prune else None
        rows = dim.current(wide, cells=None if asked is None else dim.cells_of(asked))
    else:
        rows = dim.select(*wide)
    rows = rows.select(*(F.col(c).alias(f"_dim_{c}") for c in wide))
    condition = reduce(lambda a, b: a & b, (facts[f] == rows[f"_dim_{d}"] for f, d in on.items()))
    for f, d in extra.items():
        condition = condition & equal(facts[f], rows[f"_dim_{d}"], spec.schema[d].dataType)
    return facts.join(rows, condition, how).select(*(facts[c] for c in facts.columns), *(rows[f"_dim_{c}"].alias(f"{c}{suffix}") for c in shown))


def delete_predicate(spec: TableSpec, equalities: Iterable[tuple[str, object]]) -> dict:
    """The key of a DELETE whose predicate is these equalities: each key column
    once, each literal of the column's own type and not null. Others are NotSupported."""
    out: dict = {}
    kinds = {
        T.IntegerType: int, T.LongType: int, T.StringType: str, T.DateType: date, T.TimestampNTZType: datetime,
    }
    for column, value in equalities:
        if column not in spec.primary_key or column in out:
            raise NotSupported("a delete takes each key column once, and nothing else")
        wanted = kinds[type(spec.schema[column].dataType)]
        if value is None or isinstance(value, bool) or not isinstance(value, wanted) or wanted is date and isinstance(value, datetime):
            raise NotSupported(f"{column}: the literal does not have the column's type")
        out[column] = value
    if len(out) != len(spec.primary_key):
        raise NotSupported("a delete needs the whole key")
    return out
