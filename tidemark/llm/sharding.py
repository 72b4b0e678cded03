"""Contiguous byte-balanced shards by global prefix sums.

Rows are put in one global order (id, checksum, size, then place of storage) and
dealt to range partitions, in which a running sum gives each its place on the
partition's byte line; so they are written. Each partition's total is summed, the
totals' prefix sums give every partition its offset, and the global line is cut at
equal targets. One shuffle, of about 30 bytes a row and of the columns to ``keep``:
with texts among them, the rows are then stored in the order of their shards.

Cases: null and empty texts have size 1; a null id sorts first; ties and
repeated rows are told apart by their place of storage, which can only exchange
rows of equal id and text; an empty table gives an empty table; other columns are
ignored. A row longer than a shard's target may leave shards empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shipping import ship

from ._common import documents, stage

#: Partition totals go to the driver: this many at most, whatever the input.
MAX_PARTITIONS = 100_000
ORDER = ("k_id", "k_crc", "k_size", "k_place")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds k_upto, the sum of k_size up to each row of a partition, and k_nth, its number."""
    at = rows = 0
    for batch in batches:
        upto = at + np.cumsum(batch.column(batch.schema.get_field_index("k_size")).to_numpy())
        nth = rows + np.arange(batch.num_rows)
        at, rows = int(upto[-1]) if len(upto) else at, rows + batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.int64()), pa.array(nth, pa.int64())], names=[*batch.schema.names, "k_upto", "k_nth"])


def place(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row (see the module), and its columns ``keep``."""
    spark = df.sparkSession
    ship(spark)
    keep = list(keep)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTITIONS)
    sized = df.select(
        F.col(id_col).alias("k_id"), F.crc32(text).alias("k_crc"), (F.octet_length(text) + 1).cast("long").alias("k_size"),
        F.monotonically_increasing_id().alias("k_place"), *(F.col(c).alias(f"own_{c}") for c in keep),
    )
    dealt = sized.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).withColumn("k_part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("k_upto", T.LongType()), T.StructField("k_nth", T.LongType())])
    dealt = stage(dealt.mapInArrow(_running, schema), "ranges")
    totals = dealt.groupBy("k_part").agg(F.sum("k_size").alias("b"), F.count("*").alias("r")).collect()
    offsets, at, rows = [], 0, 0
    for t in sorted(totals, key=lambda t: t["k_part"]):
        offsets.append((t["k_part"], at, rows))
        at, rows = at + t["b"], rows + t["r"]
    total = max(at, 1)
    line = dealt.join(F.broadcast(spark.createDataFrame(offsets, "k_part int, k_bytes long, k_rows long")), "k_part").select(
        F.col("k_id").alias("doc_id"), F.col("k_size").alias("size"), F.col("k_crc").alias("text_crc32"), (F.col("k_rows") + F.col("k_nth")).alias("k_row"),
        # a row belongs to the shard that holds the middle of its bytes; halves are avoided by doubling
        _cut(2 * (F.col("k_bytes") + F.col("k_upto")) - F.col("k_size"), 2 * total, shards).alias("shard"), *(F.col(f"own_{c}") for c in keep),
    )
    firsts = line.groupBy("shard").agg(F.min("k_row").alias("k_first"))  # a row a shard
    return line.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("k_row") - F.col("k_first")).alias("slot"), *(F.col(f"own_{c}").alias(c) for c in keep)
    )


def _cut(position, total: int, shards: int):
    """Integer division; longs hold it up to 2**58 bytes over ``shards`` = 16."""
    at = position * F.lit(shards)
    return F.least(((at - at % F.lit(total)) / F.lit(total)).cast("int"), F.lit(shards - 1))


def op8_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP8_SQL = """
WITH table_ AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([CAST(i AS BIGINT)] || list_transform(range(8), lambda x: CAST(x AS BIGINT)),
                        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
s AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
        xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda p: CAST(('0x' || p) AS BIGINT)),
                        lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS INTEGER)])), 4294967295) AS text_crc32
      FROM documents, table_),
l AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS r,
             sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM s),
c AS (SELECT doc_id, size, text_crc32, r, CAST(least(((2 * upto - size) * 16) // (2 * total), 15) AS INTEGER) AS shard FROM l)
SELECT doc_id, size, text_crc32, shard, CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot, 'bytes' AS law,
       CAST(NULL AS INTEGER) AS grown_shard
FROM c
"""
