import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import BadRequest
from tidemark.functions.changelog import is_delete
from tidemark.functions.equality import equal
from tidemark.functions.hashing import xxhash64
from tidemark.functions.keys import decode_key, encode_key, encoded, prefix_next
from tidemark.spec import TableSpec


def test_golden_key_bytes(spark):
    row = spark.range(1).select(
        F.lit(-1).alias("i"), F.lit("abc").alias("s"), F.lit(dt.date(1969, 12, 31)).alias("d"), F.lit(1).alias("t"),
        F.lit("1969-12-31 23:59:59.999").cast("timestamp_ntz").alias("ts"), F.lit(bytes([1, 2, 3, 0])).alias("b"),
    )
    key = F.concat(
        encoded(F.col("i"), T.IntegerType()), encoded(F.col("s"), T.StringType()), encoded(F.col("d"), T.DateType()),
        encoded(F.col("t"), T.IntegerType(), time=True), encoded(F.col("ts"), T.TimestampNTZType(), nanos=F.lit(5)), encoded(F.col("b"), T.BinaryType()),
    )
    assert row.select(F.hex(key)).first()[0].lower() == (
        "057fffffff016162630000000000fa097fffffff0a00000001087fffffffffffffff00000005010102030000000000fb"
    )


def test_key_bytes_order_as_tuples(spark):
    values = [(i, s) for i in (-(2**31), -1, 0, 1, 2**31 - 1) for s in ("", "a", "a\0", "abcdefgh", "abcdefghi", "b", "é")]
    df = spark.createDataFrame(values, "i int, s string")
    got = [(r.i, r.s) for r in df.orderBy(encode_key(df.schema, ["i", "s"])).collect()]
    assert got == sorted(values, key=lambda v: (v[0], v[1].encode()))


def test_integer_widths(spark):
    df = spark.createDataFrame([(-128, -(2**15), -(2**63)), (127, 2**15 - 1, 2**63 - 1)], "a tinyint, b smallint, c bigint")
    rows = df.select(F.hex(encode_key(df.schema, ["a", "b", "c"])).alias("k")).collect()
    assert [r.k for r in rows] == ["0300" + "040000" + "06" + "0" * 16, "03FF" + "04FFFF" + "06" + "F" * 16]


def test_timestamp_millis_refuses_finer(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-01 00:00:00.0001' AS t")
    with pytest.raises(Exception, match="whole milliseconds"):
        df.select(encoded(F.col("t"), T.TimestampNTZType(), millis=True)).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(encoded(F.lit(86_400_000), T.IntegerType(), time=True)).collect()
    with pytest.raises(BadRequest):
        encoded(F.col("x"), T.BooleanType())


def test_prefix_next():
    assert prefix_next(b"a") == b"b"
    assert prefix_next(b"a\xff\xff") == b"b"
    assert prefix_next(b"\xff") is None
    assert prefix_next(b"") is None


def _eq(spark, kind, a, b):
    df = spark.createDataFrame([(a, b)], T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    return df.select(equal(F.col("a"), F.col("b"), kind).alias("e")).first().e


def test_equality_is_sql_true(spark):
    d = T.DoubleType()
    assert _eq(spark, d, 0.0, -0.0) and not _eq(spark, d, math.nan, math.nan) and not _eq(spark, d, None, None)
    a = T.ArrayType(T.IntegerType())
    assert _eq(spark, a, [1, 2], [1, 2]) and not _eq(spark, a, [1, None], [1, None]) and not _eq(spark, a, [1], [1, 2]) and _eq(spark, a, [], [])
    m = T.MapType(T.StringType(), T.DoubleType())
    assert _eq(spark, m, {"x": 1.0, "y": 2.0}, {"y": 2.0, "x": 1.0}) and not _eq(spark, m, {"x": None}, {"x": None}) and not _eq(spark, m, {"x": 1.0}, {"y": 1.0})
    s = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", a)])
    assert _eq(spark, s, (1, [2]), (1, [2])) and not _eq(spark, s, (None, [2]), (None, [2])) and not _eq(spark, s, None, (1, [2]))


def test_change_kinds(spark):
    df = spark.createDataFrame([("+I",), ("+U",), ("-D",), ("-U",)], "k string")
    assert [r.d for r in df.select(is_delete(F.col("k")).alias("d")).collect()] == [False, False, True, True]
    with pytest.raises(Exception, match="unknown change kind"):
        spark.createDataFrame([("?",)], "k string").select(is_delete(F.col("k"))).collect()


def test_hash_on_the_driver_is_that_of_plans(spark):
    spec = TableSpec(T.StructType.fromDDL("a INT, b BIGINT, c STRING, d DATE, e TIMESTAMP_NTZ"), ("a", "b", "c", "d", "e"))
    kinds = [f.dataType for f in spec.schema.fields]
    rows = [(1, -5, "", dt.date(1969, 1, 1), dt.datetime(1960, 1, 1, 1, 2, 3, 456789)), (-7, 1 << 40, "é" * 50, dt.date(2024, 2, 29), dt.datetime(2024, 1, 1)), (0, 0, "x", dt.date(1970, 1, 1), dt.datetime(1970, 1, 1))]
    got = [r[0] for r in spark.createDataFrame(rows, spec.schema).selectExpr("xxhash64(a, b, c, d, e)").collect()]
    assert got == [xxhash64(zip(r, kinds, strict=True)) for r in rows]


def test_keys_are_decoded():
    schema = T.StructType.fromDDL("a STRING, b BIGINT, c DATE")
    whole = bytes.fromhex("01" + "6162636465666768" + "FF" + "0000000000000000" + "F7" + "06" + "8000000000000005" + "09" + "80000001")
    assert decode_key(whole, schema, ["a", "b", "c"]) == ("abcdefgh", 5, dt.date(1970, 1, 2))
    assert decode_key(whole[:19], schema, ["a", "b", "c"]) == ("abcdefgh",)
    for bad in (whole[:-1], whole[:10], b"\x02", whole + b"\0", b"\x01" + b"a" * 8 + b"\xf8"):
        with pytest.raises(BadRequest):
            decode_key(bad, schema, ["a", "b", "c"])
