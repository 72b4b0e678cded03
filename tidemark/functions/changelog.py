"""From change kinds to puts and deletes with a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import BadRequest
from tidemark.spec import TableSpec, nullable

PUTS, DELETES = ("+I", "+U"), ("-D", "-U")


def is_delete(kind: Column) -> Column:
    """False for inserts and updates after, true for deletes and updates before; anything else is an error."""
    return (
        F.when(kind.isin(*PUTS), F.lit(False))
        .when(kind.isin(*DELETES), F.lit(True))
        .otherwise(F.raise_error(F.concat(F.lit("unknown change kind: "), F.coalesce(kind, F.lit("null")))).cast("boolean"))
    )


def ordered(df: DataFrame, spec: TableSpec, kind_col: str | None = None, order_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a changelog batch in the order of their sequences. Columns other than the table's are refused."""
    known = {*spec.columns, *([kind_col] if kind_col else []), *order_by}
    if missing := [c for c in spec.columns if c not in df.columns]:
        raise BadRequest(f"a write needs whole rows; missing: {missing}")
    if unknown := [c for c in df.columns if c not in known]:
        raise BadRequest(f"unknown columns: {unknown}")
    rows = df.orderBy(*order_by) if order_by else df
    return rows.withColumn("_place", F.monotonically_increasing_id())


def changes(rows: DataFrame, spec: TableSpec, starts: DataFrame, kind_col: str | None = None) -> DataFrame:
    """``ordered`` rows as they are stored: ``spec.stored()``.

    ``starts`` says at which sequence each partition (_part) of ``rows`` begins, so
    sequences are contiguous over all. A null in a key or a not-null column of a put
    is an error. Deletes keep the key only."""
    gone = is_delete(F.col(kind_col)) if kind_col else F.lit(False)
    rows = rows.withColumns({"_part": F.shiftright("_place", 33), "_deleted": gone}).join(F.broadcast(starts), "_part")
    rows = rows.withColumn("_seq", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    cols = []
    for f in spec.schema.fields:
        kind = nullable(f.dataType)
        c = F.col(f.name).cast(kind)
        if f.name in spec.primary_key:
            c = F.coalesce(c, F.raise_error(F.lit(f"null in primary key column {f.name}")).cast(kind))
        else:
            if not f.nullable:
                c = F.when(F.col("_deleted") | c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"null in column {f.name}")).cast(kind))
            c = F.when(~F.col("_deleted"), c)
        cols.append(c.alias(f.name))
    return rows.select(*cols, "_seq", "_deleted")
