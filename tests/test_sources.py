import base64
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import wire
from tidemark.client import Client, Unreachable
from tidemark.errors import BadRequest, SchemaMismatch, ShuttingDown
from tidemark.functions.keys import decode_key, encode_key
from tidemark.operators.table import Table
from tidemark.sources import datasource
from tidemark.sources.datasource import register
from tidemark.sources.json_rows import from_json, json_column, to_json
from tidemark.server import Server
from tidemark.service import Service
from tidemark.spec import TableSpec, columns
from tidemark.streaming.buffer import BufferedWriter
from tidemark.streaming.streams import lookup_stream, upsert_stream

SPEC = TableSpec(columns(id="int", marker="string"), ("id",), buckets=2)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_values(spark):
    spec = TableSpec(T.StructType.fromDDL("id BIGINT, d DATE, t TIMESTAMP_NTZ, b BINARY, m DECIMAL(20,4), f DOUBLE, x BOOLEAN, s STRING"), ("id",))
    row = {"id": 1, "d": -1, "t": 1500, "b": base64.b64encode(b"\0a").decode(), "m": "1.5000", "f": 0.5, "x": True, "s": "é", "more": 1}
    got = from_json(spec, row)
    assert got == {"id": 1, "d": dt.date(1969, 12, 31), "t": dt.datetime(1970, 1, 1, 0, 0, 1, 500000), "b": b"\0a", "m": Decimal("1.5000"), "f": 0.5, "x": True, "s": "é"}
    assert to_json(spec, got) == {k: v for k, v in row.items() if k != "more"}
    assert from_json(spec, {"id": 1})["s"] is None
    for bad in ({"id": "x"}, {"id": True}, {"x": 1}, {"b": "*"}, {"d": "soon"}):
        with pytest.raises(BadRequest):
            from_json(spec, bad)


def test_data_source(spark, tmp_path, monkeypatch):
    register(spark)
    t = Table.create(spark, f"{tmp_path}/t", SPEC)
    t.write_batch([("+I", {"id": i, "marker": f"b{i}"}) for i in range(6)])
    t.sink_all()
    t.evict()
    new = spark.createDataFrame([(1, "hot", "+U"), (2, None, "-D"), (9, "new", "+I")], "id int, marker string, k string").coalesce(1)
    new.write.format("tidemark").mode("append").option("kind", "k").save(f"{tmp_path}/t")
    df = spark.read.format("tidemark").load(f"{tmp_path}/t")
    want = [(0, "b0"), (1, "hot"), (3, "b3"), (4, "b4"), (5, "b5"), (9, "new")]
    assert rows(df) == want == rows(Table.open(spark, f"{tmp_path}/t").current())
    assert rows(df.where("id = 1")) == [(1, "hot")] and rows(df.where("id = 2")) == [] and rows(df.where("id = 3").select("marker")) == [("b3",)]
    assert Table.open(spark, f"{tmp_path}/t").m.next_seq == 10  # contiguous: six, a sink, three
    reader = datasource.TidemarkReader(f"{tmp_path}/t", SPEC)
    assert len(reader.partitions()) == 3  # two cells, and what is in none
    list(reader.pushFilters([datasource.EqualTo(("id",), 3)]))
    (one,) = reader.partitions()
    assert len(one.folders) == 1 and one.runs  # one cell of two; the run may hold the key
    monkeypatch.setattr(datasource, "TASKS", 1)
    assert rows(spark.read.format("tidemark").load(f"{tmp_path}/t")) == want
    with pytest.raises(Exception, match="append"):
        new.drop("k").write.format("tidemark").mode("overwrite").save(f"{tmp_path}/t")
    with pytest.raises(Exception, match="exactly the columns"):
        new.write.format("tidemark").mode("append").save(f"{tmp_path}/t")


def test_data_source_writes_by_many_tasks(spark, tmp_path):
    register(spark)
    t = Table.create(spark, f"file://{tmp_path}/t", SPEC)
    df = spark.createDataFrame([(i % 40, f"m{i}", i) for i in range(400)], "id int, marker string, n int").repartition(5, "id").sortWithinPartitions("n").drop("n")
    df.write.format("tidemark").mode("append").save(f"file://{tmp_path}/t")
    t.refresh()
    assert t.m.next_seq == 401 and len(t.m.runs) == 5 and {r.shift > 0 for r in t.m.runs} == {True}
    want = [(i, f"m{360 + i}") for i in range(40)]
    assert rows(t.current()) == want == rows(spark.read.format("tidemark").load(f"{tmp_path}/t"))
    seqs = sorted(r[0] for r in t._runs(t.m.runs).select("_seq").collect())
    assert seqs == list(range(1, 401))
    t.sink_all()
    assert rows(t.base()) == want
    with pytest.raises(Exception, match="null in a primary key"):
        df.selectExpr("cast(null AS int) AS id", "marker").write.format("tidemark").mode("append").save(f"{tmp_path}/t")
    for _ in range(20):
        t.m.runs.append(datasource.mf.Run("x", datasource.mf.NEW, 0, 0, 0, 0, 0, 0, 0.0))
    t._publish()
    with pytest.raises(Exception, match="wait for maintenance"):
        df.write.format("tidemark").mode("append").save(f"{tmp_path}/t")


def test_json_column_has_no_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spec = TableSpec(columns(id="int", t="timestamp_ntz"), ("id",))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t")
        assert json_column(df, spec).first().json == '{"id":1,"t":1704067200000}'
        gap = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00' AS t").select(F.hex(encode_key(spec.schema, ["t"])).alias("k")).first()
        assert decode_key(bytes.fromhex(gap.k), spec.schema, ["t"]) == (dt.datetime(2024, 3, 10, 2, 30),)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_wire_and_http(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t", SPEC)
    changes = [("+I", {"id": 1, "marker": "é"}), ("-D", {"id": 2, "marker": None}), ("+U", {"id": 3, "marker": None})]
    assert wire.decode_changes(SPEC, wire.encode_changes(SPEC, changes)) == changes
    assert wire.decode_rows(SPEC, wire.encode_rows(SPEC, [{"id": 1, "marker": "x"}]), ["marker"]) == [{"marker": "x"}]
    with pytest.raises(BadRequest):
        wire.decode_changes(SPEC, b"nonsense")
    server = Server(Service(t), max_bytes=100_000)
    try:
        c = Client(server.port, SPEC)
        assert c.write_batch(changes) == 3 and c.write({"id": 4, "marker": "d"}) == 4 and c.delete({"id": 3}) == 5
        assert c.get({"id": 1}) == {"id": 1, "marker": "é"} and c.get({"id": 3}) is None and c.get_local({"id": 2})["result"] == "DELETED"
        assert c.prefix_local({"id": 4}) == [{"id": 4, "marker": "d"}] and c.state()["open_rows"] == 5
        assert c.get_binary([{"id": 1}, {"id": 3}, {"id": 9}], local=True) == [("HIT", {"id": 1, "marker": "é"}), ("DELETED", None), ("MISS", None)]
        assert c.flush() == c.sink() == 5
        with pytest.raises(BadRequest):
            c.get({"x": 1})
        with pytest.raises(BadRequest, match="bytes"):
            c.write_batch([("+I", {"id": 1, "marker": "x" * 200_000})])
        with pytest.raises(SchemaMismatch):
            Client(server.port, TableSpec(columns(id="int"), ("id",)))
        t.close()
        with pytest.raises(ShuttingDown):
            Client(server.port, SPEC, write_retries=0).write({"id": 1, "marker": "x"})
    finally:
        server.close()
    with pytest.raises(Unreachable):
        Client(server.port, SPEC)


def test_buffer(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t", SPEC)
    now = [0.0]
    out = BufferedWriter(t, max_rows=3, max_bytes=50, interval=5, clock=lambda: now[0])
    for i in range(2):
        out.add("+I", {"id": i, "marker": "a"})
    assert t.m.next_seq == 1
    out.add("+I", {"id": 2, "marker": "a"})  # by rows
    assert t.m.next_seq == 4
    out.add("+I", {"id": 3, "marker": "a" * 60})  # by bytes
    assert t.m.next_seq == 5
    out.add("-D", {"id": 3})
    now[0] = 6.0
    assert out.due()
    out.add("+I", {"id": 5, "marker": "b"})  # by time
    assert t.m.next_seq == 7 and out.flush() is None and t.metrics.counters["rows_flushed"] == 6
    assert rows(t.current()) == [(0, "a"), (1, "a"), (2, "a"), (5, "b")]


def test_streams(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t", SPEC)
    source = f"{tmp_path}/in"
    schema = "id int, marker string, k string, n long"
    spark.createDataFrame([(1, "a", "+I", 1), (2, "b", "+I", 2), (1, "c", "+U", 3)], schema).coalesce(1).write.parquet(f"{source}/x=0")

    def once():
        files = spark.readStream.schema(schema).parquet(f"{source}/*")
        q = upsert_stream(t, files, f"{tmp_path}/c", "k", ("n",)).start()
        q.processAllAvailable()
        q.stop()

    once()
    assert rows(t.current()) == [(1, "c"), (2, "b")]
    spark.createDataFrame([(2, None, "-D", 4), (3, "d", "+I", 5)], schema).coalesce(1).write.parquet(f"{source}/x=1")
    once()  # goes on from its checkpoint
    assert rows(t.current()) == [(1, "c"), (3, "d")]

    got = []
    spark.createDataFrame([(10, 1), (11, 2), (12, None)], "o int, k int").write.parquet(f"{tmp_path}/facts")
    facts = spark.readStream.schema("o int, k int").parquet(f"{tmp_path}/facts")
    q = lookup_stream(facts, t, {"k": "id"}, lambda df, n: got.extend(df.collect()), f"{tmp_path}/c2", columns=["marker"]).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.o, r.marker) for r in got) == [(10, "c"), (11, None), (12, None)]
