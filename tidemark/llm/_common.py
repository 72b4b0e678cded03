"""Helpers shared by the corpus operators: Arrow batch mapping, byte-level
tokenisation and tables staged in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import shared_dir, ship

#: Output batches are cut at about so many bytes, whatever the input batch held.
BATCH_BYTES = 8 << 20

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, on UTF-8 bytes:
#: every other byte becomes a space. All bytes of a multi-byte character are
#: word bytes, so words are those of the character-level pattern.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def alnum_words(data: bytes) -> list[bytes]:
    return data.translate(_ALNUM).split()


def space_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (bytes methods are ASCII only)."""
    return data.lower().split()


def stage(df: DataFrame, label: str, codec: str = "zstd", **options: object) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage
    ends there, and a lost executor costs only its own running tasks. ``options``
    are the writer's (dots as double underscores)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(compression=codec, **{k.replace("__", "."): v for k, v in options.items()}).parquet(path)
    return spark.read.schema(schema).parquet(path)


def trim() -> None:
    """Give memory that is free back to the system: Python workers live on
    between tasks, beside those that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(
    df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[tuple]], schema: str | object, size_of: Callable | None = None
) -> DataFrame:
    """``df.mapInArrow`` for a function that yields tuples for a batch; output
    is cut so that a batch of long values stays small."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for row in rows(batch):
                out.append(row)
                size += 64 + (size_of(row) if size_of else 0)
                if size >= BATCH_BYTES:
                    yield _batch(out, arrow)
                    out, size = [], 0
            if out:
                yield _batch(out, arrow)
        trim()

    return df.mapInArrow(run, spark_schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=field.type) for col, field in zip(zip(*rows), schema, strict=True)], schema=schema
    )


def utf8(column: pa.Array) -> Iterator[bytes]:
    """Each text of a string column as UTF-8 bytes; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator works on, whatever else is there."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
