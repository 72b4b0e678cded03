"""Queries over the driver's tables, one or more for each operator, and their SQL.

``events`` is the changelog: key user_id, sequence event_id, an error deletes.
Its last tenth is the hot tier where a query needs tiers."""

from __future__ import annotations

import json
import math
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import wire
from tidemark.client import Client
from tidemark.config import Options, retried
from tidemark.errors import STATUSES, BadRequest, LookupUnavailable, TidemarkError, WriterFenced
from tidemark.functions.changelog import is_delete
from tidemark.functions.keys import decoded_keys, encode_key
from tidemark.operators import lookup
from tidemark.operators.scheduler import sink_selection
from tidemark.operators.table import Table
from tidemark.plans.merge import current, latest, tristate
from tidemark.plans.storage import Store
from tidemark.server import Server
from tidemark.service import Service
from tidemark.shipping import shared_dir
from tidemark.sources.datasource import register
from tidemark.sources.json_rows import json_column
from tidemark.spec import TableSpec, columns
from tidemark.streaming.buffer import BufferedWriter
from tidemark.streaming.streams import lookup_stream, upsert_stream

KEY = ["user_id"]
EVENTS = TableSpec(columns(user_id="bigint", event_id="bigint", event_type="string", value="double"), ("user_id",), buckets=4)
PAIRS = TableSpec(columns(user_id="bigint", event_type="string", event_id="bigint", value="double"), ("user_id", "event_type"), ("event_type",), 2)
CUSTOMERS = TableSpec(columns(c_custkey="bigint", c_name="string", last_status="string", last_price="double"), ("c_custkey",))
HELD_OPEN = Options(freeze_rows=sys.maxsize, freeze_bytes=sys.maxsize)  #: a batch of any size stays open until the query itself freezes it


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def changelog(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select(
        "user_id", "event_id", "event_type", "value", F.col("event_id").alias("_seq"), (F.col("event_type") == "error").alias("_deleted")
    )


def tiers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(base rows, hot changes): the events up to nine tenths of the greatest id, and those after."""
    log = changelog(spark, d)
    cut = log.agg(F.max("_seq")).first()[0] * 9 // 10
    return current(log.where(F.col("_seq") <= cut), KEY), latest(log.where(F.col("_seq") > cut), KEY)


def _table(spark: SparkSession, spec: TableSpec, options: Options = Options()) -> Table:
    return Table.create(spark, f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}", spec, options)


def _kinds(df: DataFrame) -> DataFrame:
    return df.withColumn("_kind", F.when(F.col("event_type") == "error", "-D").otherwise("+I"))


def _batches(spark: SparkSession, d: str, n: int) -> list[DataFrame]:
    """The changelog in ``n`` parts, by sequence."""
    log = _kinds(_read(spark, d, "events").select(*EVENTS.columns))
    top = log.agg(F.max("event_id")).first()[0] + 1
    return [log.where((F.col("event_id") >= top * i // n) & (F.col("event_id") < top * (i + 1) // n)) for i in range(n)]


def _filled(spark: SparkSession, d: str, n: int, options: Options = Options(), flush: bool = True) -> Table:
    t = _table(spark, EVENTS, options)
    for b in _batches(spark, d, n):
        t.append(b, "_kind", ("event_id",))
        if flush:
            t.flush_all()
    return t


def current_state(spark, d):
    return current(changelog(spark, d), KEY)


def current_state_max_by(spark, d):
    """The other form of the merge, with a struct of just the columns asked for."""
    one = latest(changelog(spark, d), KEY, ["value", "_deleted"], form="max_by")
    return one.where("NOT _deleted").select("user_id", "value")


def current_state_with_tombstones(spark, d):
    return latest(changelog(spark, d), KEY).select("user_id", "event_id", F.col("_deleted").alias("deleted"))


def _probe_keys(spark, d):
    return _read(spark, d, "events").select("user_id").union(_read(spark, d, "customer").select("c_custkey")).distinct()


def local_get_tristate(spark, d):
    """The tri-state of plans: hot changes alone, as a DataFrame."""
    _, hot = tiers(spark, d)
    return tristate(_probe_keys(spark, d), hot.select("user_id", "event_id", "_seq", "_deleted"), KEY)


def full_get_tristate(spark, d):
    """Bulk lookup in a table with a base and a hot tier: hot changes are final, other keys fall through."""
    t = _table(spark, EVENTS)
    first, last = _batches(spark, d, 2)
    t.append(first, "_kind", ("event_id",))
    t.sink_all()
    t.evict()
    t.append(last, "_kind", ("event_id",))
    return lookup.get_many(t, _probe_keys(spark, d), ["event_id"]).select(
        "user_id", F.when(F.col("result") == "HIT", "HIT").otherwise("NONE").alias("result"), "event_id"
    )


def full_get_fallthrough(spark, d):
    return _layered(spark, d).current()


def bulk_miss(spark, d):
    """Keys that are not there: each is a miss, none a row."""
    keys = _probe_keys(spark, d).select((-F.col("user_id") - 1).alias("user_id"))
    return lookup.get_many(_layered(spark, d), keys, []).select("user_id", "result")


def projected_get(spark, d):
    return _layered(spark, d).current(["user_id", "value"])


LOOKED_UP = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, -1)  #: keys of point reads


_built: dict[tuple, str] = {}


def _shared(spark, d, name: str, build: Callable[[], Table]) -> Table:
    """A table that several queries only read: built by the first of them in an application."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _built or not Store(spark, _built[at]).exists("table.json"):
        _built[at] = build().store.root
    return Table.open(spark, _built[at])


def _layered(spark, d) -> Table:
    return _shared(spark, d, "layered", lambda: _new_layered(spark, d))


def _new_layered(spark, d, options: Options = HELD_OPEN) -> Table:
    """A quarter of the changelog each: two in the base, one in a run, one in an open batch.
    These are the layers at any size, so no batch is frozen for its size."""
    t = _table(spark, EVENTS, options)
    for i, b in enumerate(_batches(spark, d, 4)):
        t.append(b, "_kind", ("event_id",))
        if i == 1:
            t.sink_all()
            while t.evict():
                pass
        if i == 2:
            t.flush_all()
    return t


def _events(spark, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in EVENTS.columns) for r in rows if r is not None], EVENTS.schema)


def point_get(spark, d):
    t = _layered(spark, d)
    return _events(spark, [lookup.get(t, {"user_id": k}) for k in LOOKED_UP])


def run_point_get(spark, d):
    """Reads that only runs answer: their key ranges, then statistics and Bloom filters of their files."""
    t = _filled(spark, d, 2)
    return _events(spark, [lookup.get(t, {"user_id": k}) for k in LOOKED_UP])


def projected_point_get(spark, d):
    t = _layered(spark, d)
    rows = [lookup.get(t, {"user_id": k}, ["value", "user_id"]) for k in LOOKED_UP]
    return spark.createDataFrame([(r["user_id"], r["value"]) for r in rows if r], "user_id long, value double")


def local_get(spark, d):
    t = _layered(spark, d)
    found = [(k, *lookup.get_local(t, {"user_id": k})) for k in LOOKED_UP]
    return spark.createDataFrame([(k, result, row and row["event_id"]) for k, result, row in found], "user_id long, result string, event_id long")


def bulk_get_pruned(spark, d):
    """Few keys: only their cells are opened."""
    t = _layered(spark, d)
    keys = spark.createDataFrame([(k,) for k in LOOKED_UP], "user_id long")
    return lookup.get_many(t, keys, ["event_id"]).select("user_id", F.when(F.col("result") == "HIT", "HIT").otherwise("NONE").alias("result"), "event_id")


def bulk_local_get(spark, d):
    return lookup.get_many(_layered(spark, d), _probe_keys(spark, d), ["event_id"], local=True)


def candidate_runs(spark, d):
    """Which of four runs may hold a key, by the key ranges in the manifest."""
    t = _shared(spark, d, "four runs", lambda: _filled(spark, d, 4))
    at = {r.id: i for i, r in enumerate(t.m.runs)}
    rows = [(k, at[r.id]) for k in LOOKED_UP for r in t.runs_within((k, k))]
    return spark.createDataFrame(rows, "user_id long, run long")


def key_only_range(spark, d):
    """The keys of a range, and nothing else of it."""
    return lookup.scan(_layered(spark, d), {"user_id": 10}, {"user_id": 40}, ["user_id"])


def hot_cell_reads(spark, d):
    """Reads after their cells have been read so often that they are kept in memory."""
    t = Table.open(spark, _layered(spark, d).store.root, options=Options(hot_threshold=1))
    for _ in range(2):
        rows = [lookup.get(t, {"user_id": k}) for k in LOOKED_UP]
    out = _events(spark, rows)
    t.close()
    return out


def repaired_reads(spark, d):
    """A reader whose files have gone since it opened the table."""
    t = _new_layered(spark, d)
    reader = Table.open(spark, t.store.root, EVENTS)
    t.sink_all()
    while t.evict():
        pass
    t.vacuum()
    return _events(spark, [lookup.get(reader, {"user_id": k}) for k in LOOKED_UP])


def refreshed_reader(spark, d):
    t = _table(spark, EVENTS)
    reader = Table.open(spark, t.store.root, EVENTS)
    for b in _batches(spark, d, 2):
        t.append(b, "_kind", ("event_id",))
    return reader.refresh().current(["user_id", "event_id", "event_type"])


def taken_over(spark, d):
    """A second writer goes on; the first one cannot publish any more."""
    first, last = _batches(spark, d, 2)
    t = _table(spark, EVENTS)
    t.append(first, "_kind", ("event_id",))
    other = Table.open(spark, t.store.root, EVENTS, take_over=True)
    try:
        t.append(first, "_kind", ("event_id",))
        raise AssertionError("two writers")
    except WriterFenced:
        other.append(last, "_kind", ("event_id",))
    return other.current(["user_id", "event_id", "event_type"])


def fresh_writer(spark, d):
    """A new writer for an existing base: what was not sunk is forgotten, sequences begin at 1."""
    first, last = _batches(spark, d, 2)
    t = _table(spark, EVENTS)
    t.append(first, "_kind", ("event_id",))
    t.sink_all()
    t.append(last.limit(0), "_kind", ("event_id",))
    other = Table.open(spark, t.store.root, EVENTS, fresh_writer=True)
    assert other.m.next_seq == 1
    return other.current(["user_id", "event_id", "event_type"])


def fenced_sink(spark, d):
    """Asked for, then done by maintenance: the sequences up to which it is."""
    t = _filled(spark, d, 2, flush=False)
    fences = t.request_flush(), t.request_sink()
    t.maintain()
    s = t.state()
    return spark.createDataFrame([(*fences, s["flushed_seq"], s["persisted_seq"])], "flush_fence long, sink_fence long, flushed_seq long, persisted_seq long")


def state_counts(spark, d):
    s = _layered(spark, d).state()
    return spark.createDataFrame([(s["new_runs"], s["new_rows"], s["open_runs"], s["open_rows"], s["next_seq"], s["commits"])], "new_runs long, new_rows long, open_runs long, open_rows long, next_seq long, commits long")


def delete_predicate(spark, d):
    """DELETE ... WHERE, from the equalities of its predicate."""
    t = _filled(spark, d, 1, flush=False)
    t.delete_where(lookup.delete_predicate(EVENTS, [("user_id", 7)]))
    return t.current(["user_id", "event_id", "event_type"])


def source_read(spark, d):
    register(spark)
    return spark.read.format("tidemark").load(_layered(spark, d).store.root).select("user_id", "event_id", "event_type")


def source_point_read(spark, d):
    register(spark)
    return spark.read.format("tidemark").load(_layered(spark, d).store.root).where("user_id = 13").select("user_id", "event_id", "event_type", "value")


def source_write(spark, d):
    """INSERT and DELETE by the data source, a key's changes in one task."""
    register(spark)
    t = _table(spark, EVENTS)
    for b in _batches(spark, d, 2):
        b.repartition(3, "user_id").sortWithinPartitions("event_id").write.format("tidemark").mode("append").option("kind", "_kind").save(t.store.root)
    return t.refresh().current(["user_id", "event_id", "event_type"])


def buffered_upserts(spark, d):
    """Row by row: batches are cut by rows here, and what is left is flushed."""
    t = _table(spark, CUSTOMERS, Options(max_batch_rows=1_000_000))
    with BufferedWriter(t, max_rows=20_000, max_bytes=1 << 30, interval=3600) as out:
        for r in _read(spark, d, "customer").select("c_custkey", "c_name").toLocalIterator():
            out.add("+I", r.asDict())
    return t.current(["c_custkey", "c_name"])


def http_lookups(spark, d):
    """The JSON calls over HTTP."""
    server = Server(Service(_layered(spark, d)))
    try:
        c = Client(server.port, EVENTS)
        return _events(spark, [c.get({"user_id": k}) for k in LOOKED_UP])
    finally:
        server.close()


def binary_lookups(spark, d):
    """The binary calls over HTTP: tri-state lookups of the hot tier."""
    server = Server(Service(_layered(spark, d)))
    try:
        found = Client(server.port, EVENTS).get_binary([{"user_id": k} for k in LOOKED_UP], local=True)
    finally:
        server.close()
    rows = [(k, result, row and row["event_id"]) for k, (result, row) in zip(LOOKED_UP, found, strict=True)]
    return spark.createDataFrame(rows, "user_id long, result string, event_id long")


def binary_writes(spark, d):
    """All customers in one binary batch, and the deletion of one, over HTTP."""
    t = _table(spark, CUSTOMERS, Options(max_batch_rows=10_000_000))
    server = Server(Service(t), max_bytes=1 << 30)
    try:
        c = Client(server.port, CUSTOMERS)
        c.write_batch([("+I", r.asDict()) for r in _read(spark, d, "customer").select("c_custkey", "c_name").toLocalIterator()])
        c.delete({"c_custkey": 1})
    finally:
        server.close()
    return t.current(["c_custkey", "c_name"])


def local_prefix(spark, d):
    return spark.createDataFrame(lookup.prefix_local(_pairs(spark, d), {"user_id": 7}, limit=math.inf), PAIRS.schema)


def json_prefix(spark, d):
    rows = Service(_pairs(spark, d)).prefix({"user_id": 7})
    return spark.createDataFrame([tuple(r[c] for c in PAIRS.columns) for r in rows], PAIRS.schema)


def lookup_null_keys(spark, d):
    """Null keys match nothing, and rows that have them stay in a left join."""
    t = _shared(spark, d, "customers", lambda: _new_customers(spark, d))
    facts = _read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("k"))
    return lookup.lookup_join(facts, t, {"k": "c_custkey"}, "left", columns=["c_name"], prune=True).select("o_orderkey", "c_name")


def _status(call: Callable) -> str:
    try:
        call()
        return "OK"
    except TidemarkError as e:
        return e.status


def refused(spark, d):
    """What is refused, and how: nothing of it is written."""
    t = _table(spark, CUSTOMERS, Options(max_new_runs=1))
    row = {"c_custkey": 1, "c_name": "a", "last_status": "O", "last_price": 1.0}
    facts = _read(spark, d, "orders").select("o_orderkey", "o_custkey")
    cases = {
        "put": lambda: t.put(**row), "part of a row": lambda: t.append(facts.select(F.col("o_custkey").alias("c_custkey"))), "null key": lambda: t.put(**row | {"c_custkey": None}),
        "unknown column": lambda: t.put(**row | {"x": 1}), "unknown kind": lambda: t.write_batch([("+X", row)]), "too many rows": lambda: t.write_batch([("+I", row)] * 2000),
        "delete of part": lambda: lookup.delete_predicate(PAIRS, [("user_id", 1)]), "delete of a value": lambda: lookup.delete_predicate(CUSTOMERS, [("c_name", "a")]),
        "delete by another type": lambda: lookup.delete_predicate(CUSTOMERS, [("c_custkey", "1")]), "update before": lambda: t.write_batch([("-U", row), ("+U", row)]),
        "prefix of all tiers": lambda: Service(t).prefix({"c_custkey": 1}, allow=False), "lookup by part of a key": lambda: lookup.lookup_join(facts, _pairs_spec(spark), {"o_custkey": "user_id"}, spec=PAIRS),
        "lookup by a field": lambda: lookup.lookup_join(facts, t, {"o_custkey": "c_custkey.x"}), "key column twice": lambda: lookup.lookup_join(facts, t, {"o_custkey": "c_custkey", "o_orderkey": "c_custkey"}),
        "schema": lambda: Table.open(spark, t.store.root, EVENTS),
    }
    rows = [(name, _status(call)) for name, call in cases.items()]
    t.flush_all()
    rows.append(("too many runs", _status(lambda: t.put(**row))))
    t.close()
    rows.append(("closed", _status(lambda: t.put(**row))))
    return spark.createDataFrame(rows, "name string, status string")


def _pairs_spec(spark) -> DataFrame:
    return spark.createDataFrame([], PAIRS.schema)


def retried_calls(spark, d):
    """How often a call is made that fails twice, by its error."""
    rows = []
    for name, error in (("passing", LookupUnavailable), ("lasting", BadRequest)):
        made: list[int] = []

        def call(error=error, made=made):
            made.append(1)
            if len(made) < 3:
                raise error("x")

        status = _status(lambda call=call: retried(call, sleep=lambda s: None))
        rows.append((name, len(made), status))
    return spark.createDataFrame(rows, "name string, calls long, status string")


def call_metrics(spark, d):
    t = _filled(spark, d, 1)
    for k in LOOKED_UP:
        lookup.get(t, {"user_id": k})
    s = t.state()["metrics"]
    return spark.createDataFrame([(s["get"], sum(s["get_ms"].values()), s["rows_written"])], "gets long, timed long, rows_written long")


def wire_rows(spark, d):
    """Rows through the binary form and back."""
    spec = TableSpec(columns(n_nationkey="int", n_name="string"), ("n_nationkey",))
    rows = [r.asDict() for r in _read(spark, d, "nation").select("n_nationkey", "n_name").collect()]
    return spark.createDataFrame([tuple(r.values()) for r in wire.decode_rows(spec, wire.encode_rows(spec, rows))], "n_nationkey int, n_name string")


def key_decode(spark, d):
    e = _read(spark, d, "events").select("user_id", "event_type").distinct()
    keys = e.select(encode_key(e.schema, ["user_id", "event_type"]).alias("key"))
    return decoded_keys(keys, "key", e.schema, ["user_id", "event_type"]).select("user_id", "event_type")


def handshake(spark, d):
    """The specification as its JSON gives it back."""
    spec = TableSpec.from_json(json.loads(json.dumps(_table(spark, PAIRS).describe())))
    rows = [(f.name, f.dataType.simpleString(), spec.primary_key.index(f.name) + 1 if f.name in spec.primary_key else 0) for f in spec.schema.fields]
    return spark.createDataFrame(rows, "name string, kind string, key_place long")


def option_defaults(spark, d):
    o = Options()
    names = ("freeze_rows", "freeze_bytes", "max_frozen", "max_new_runs", "visibility_seconds", "new_run_cap", "sinked_run_cap", "sink_bytes", "compact_bytes", "hot_threshold", "hot_bytes")
    return spark.createDataFrame([(n, getattr(o, n)) for n in names], "name string, value long")


def status_codes(spark, d):
    return spark.createDataFrame([(s,) for s in STATUSES], "status string")


def _pairs(spark, d) -> Table:
    return _shared(spark, d, "pairs", lambda: _new_pairs(spark, d))


def _new_pairs(spark, d) -> Table:
    t = _table(spark, PAIRS)
    first, last = (b.select(*PAIRS.columns) for b in _batches(spark, d, 2))
    t.append(first, order_by=("event_id",))
    t.sink_all()
    t.evict()
    t.append(last, order_by=("event_id",))
    return t


def prefix_scan(spark, d):
    rows = lookup.prefix(_pairs(spark, d), {"user_id": 7})
    return spark.createDataFrame(rows, PAIRS.schema)


def range_scan(spark, d):
    return lookup.scan(_pairs(spark, d), {"user_id": 10}, {"user_id": 20, "event_type": "error"})


def _dimension(spark, d) -> DataFrame:
    """Customers with their latest order; those whose latest is finished are gone."""
    orders = _read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("_seq"), "o_orderstatus", "o_totalprice")
    last = latest(orders, ["o_custkey"]).where("o_orderstatus <> 'F'")
    return _read(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "c_name", F.col("o_orderstatus").alias("last_status"), F.col("o_totalprice").alias("last_price")
    )


def _new_customers(spark, d) -> Table:
    t = _table(spark, CUSTOMERS)
    t.append(_dimension(spark, d))
    t.sink_all()
    return t


def _looked_up(spark, d, how, extra=None):
    t = _shared(spark, d, "customers", lambda: _new_customers(spark, d))
    facts = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return lookup.lookup_join(facts, t, {"o_custkey": "c_custkey"}, how, extra, ["c_name", "last_status"])


def lookup_join_left(spark, d):
    return _looked_up(spark, d, "left").select("o_orderkey", "o_custkey", "c_name", "last_status")


def lookup_join_inner(spark, d):
    return _looked_up(spark, d, "inner").select("o_orderkey", "o_custkey", "c_name", "last_status")


def lookup_join_extra_eq(spark, d):
    return _looked_up(spark, d, "inner", {"o_totalprice": "last_price"}).select("o_orderkey", "o_custkey", "c_name")


def delete_by_pk(spark, d):
    t = _filled(spark, d, 1, flush=False)
    t.delete_where({"user_id": 7})
    return t.current(["user_id", "event_id", "event_type"])


def changelog_kinds(spark, d):
    """All four kinds: an update comes as its row before and its row after."""
    e = _read(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "-D").when(F.col("event_type") == "click", "-U").when(F.col("event_type") == "view", "+U").otherwise("+I")
    log = e.select("user_id", "event_id", F.col("event_id").alias("_seq"), is_delete(kind).alias("_deleted"))
    return current(log, KEY)


def sink_base_state(spark, d):
    """What the base alone holds after a full sink."""
    t = _filled(spark, d, 3)
    t.sink_all()
    return t.base(columns=["event_id", "event_type"])


def compact_invariance(spark, d):
    t = _filled(spark, d, 4)
    t.compact()
    return t.current(["user_id", "event_id", "event_type"])


def evict_invariance(spark, d):
    """Sunk, evicted and vacuumed: reads come from the base."""
    t = _filled(spark, d, 3)
    t.sink_all()
    while t.evict():
        pass
    t.vacuum()
    return t.current(["user_id", "event_id", "event_type"])


def recovered_state(spark, d):
    """A sink stopped between its phases, and the table opened again."""
    t = _filled(spark, d, 2)
    t.prepare_sink()
    return Table.open(spark, t.store.root, EVENTS).current(["user_id", "event_id", "event_type"])


def maintained_state(spark, d):
    """Many small batches under maintenance with small limits."""
    t = _table(spark, EVENTS, Options(new_run_cap=2, sinked_run_cap=1, freeze_rows=1))
    for b in _batches(spark, d, 5):
        t.append(b, "_kind", ("event_id",))
        t.maintain()
    return t.current(["user_id", "event_id", "event_type"])


def run_stats(spark, d):
    """Runs of a table of four flushed batches, from its manifest."""
    return _shared(spark, d, "four runs", lambda: _filled(spark, d, 4)).runs().select("entry_count", "min_seq", "max_seq")


def sink_prefix_selection(spark, d):
    """Runs that a sink takes: one at least however little it may, all if it may."""
    t = _shared(spark, d, "four runs", lambda: _filled(spark, d, 4))
    one, whole = (sink_selection(t.m, t.m.flushed_seq, most) for most in (1, 1 << 60))
    rows = [(case, r.rows, r.min_seq) for case, runs in (("least", one), ("most", whole)) for r in runs]
    return spark.createDataFrame(rows, "case string, entry_count long, min_seq long")


def key_order(spark, d):
    """Order-preserving key bytes of (user_id, event_type)."""
    e = _read(spark, d, "events").select("user_id", "event_type").distinct()
    return e.select("user_id", "event_type", F.hex(encode_key(e.schema, ["user_id", "event_type"])).alias("key"))


def json_rows(spark, d):
    """Rows as JSON: days, milliseconds and plain values."""
    spec = TableSpec(columns(o_orderkey="bigint", o_orderdate="timestamp_ntz", o_orderstatus="string"), ("o_orderkey",))
    return json_column(_read(spark, d, "orders").select(*spec.columns), spec).select("o_orderkey", "json")


def upsert_streaming(spark, d):
    """The changelog as a stream into a table, each file a micro-batch."""
    work = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    for i, b in enumerate(_batches(spark, d, 3)):
        b.coalesce(1).write.parquet(f"{work}/in/part={i}")
    t = _table(spark, EVENTS)
    schema = T.StructType([*EVENTS.schema.fields, T.StructField("_kind", T.StringType())])
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in/*")
    q = upsert_stream(t, files, f"{work}/checkpoint", "_kind", ("event_id",)).start()
    q.processAllAvailable()
    q.stop()
    return t.current(["user_id", "event_id", "event_type"])


def lookup_streaming(spark, d):
    """Orders as a stream, joined with the table as it is at each micro-batch."""
    work = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    _read(spark, d, "orders").select("o_orderkey", "o_custkey").write.parquet(f"{work}/in")
    t = _table(spark, CUSTOMERS)
    t.append(_dimension(spark, d))
    stream = spark.readStream.schema("o_orderkey BIGINT, o_custkey BIGINT").parquet(f"{work}/in")
    then = lambda df, n: df.write.mode("append").parquet(f"{work}/out")
    q = lookup_stream(stream, t, {"o_custkey": "c_custkey"}, then, f"{work}/checkpoint", columns=["c_name", "last_status"]).start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{work}/out")


_LE = "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events {} GROUP BY 1"
_CUT = "(SELECT max(event_id) * 9 // 10 FROM events)"
_LIVE = f"SELECT user_id, event_id, event_type FROM ({_LE.format('')}) WHERE event_type <> 'error'"
_KEYS = "(SELECT user_id FROM events UNION SELECT c_custkey FROM customer)"
_DIM = (
    "(SELECT c_custkey, c_name, s AS last_status, p AS last_price FROM customer JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, "
    "arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE s <> 'F')"
)
_PAIRS = "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE {} GROUP BY 1, 2"
_TOP = "(SELECT max(event_id) + 1 FROM events)"
_HALF = f"({_TOP} * 2 // 4)"
#: The fourth of the changelog that an event is in, and its sequence.
_FOURTHS = (
    f"(SELECT *, row_number() OVER (ORDER BY event_id) AS seq, CASE WHEN event_id < {_TOP} * 1 // 4 THEN 0 WHEN event_id < {_TOP} * 2 // 4 THEN 1 "
    f"WHEN event_id < {_TOP} * 3 // 4 THEN 2 ELSE 3 END AS part FROM events)"
)
_RUNS = f"SELECT count(DISTINCT user_id) AS entry_count, min(seq) AS min_seq, max(seq) AS max_seq FROM {_FOURTHS} GROUP BY part"
_SOME = "(1, 2, 3, 5, 8, 13, 21, 34, 55, 89, -1)"
_SOME_ROWS = "(SELECT unnest([1, 2, 3, 5, 8, 13, 21, 34, 55, 89, -1])::BIGINT AS user_id)"
_GOT = f"SELECT * FROM ({_LE.format('')}) WHERE event_type <> 'error' AND user_id IN {_SOME}"
_HOT = (
    f"WITH h AS ({_LE.format(f'WHERE event_id >= {_HALF}')}) SELECT k.user_id, CASE WHEN h.event_id IS NULL THEN 'MISS' WHEN h.event_type = 'error' THEN 'DELETED' "
    "ELSE 'HIT' END AS result, CASE WHEN h.event_type <> 'error' THEN h.event_id END AS event_id FROM {} k LEFT JOIN h USING (user_id)"
)
_ORDERS = "SELECT o_orderkey, o_custkey, c_name, last_status FROM orders {} JOIN " + _DIM + " ON o_custkey = c_custkey"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "current_state": (current_state, f"SELECT * FROM ({_LE.format('')}) WHERE event_type <> 'error'"),
    "current_state_max_by": (current_state_max_by, f"SELECT user_id, value FROM ({_LE.format('')}) WHERE event_type <> 'error'"),
    "current_state_with_tombstones": (current_state_with_tombstones, f"SELECT user_id, event_id, event_type = 'error' AS deleted FROM ({_LE.format('')})"),
    "local_get_tristate": (
        local_get_tristate,
        f"WITH h AS ({_LE.format(f'WHERE event_id > {_CUT}')}) SELECT k.user_id, CASE WHEN h.event_id IS NULL THEN 'MISS' WHEN h.event_type = 'error' THEN 'DELETED' "
        f"ELSE 'HIT' END AS result, CASE WHEN h.event_type <> 'error' THEN h.event_id END AS event_id FROM {_KEYS} k LEFT JOIN h USING (user_id)",
    ),
    "full_get_tristate": (
        full_get_tristate,
        f"WITH c AS ({_LIVE}) SELECT k.user_id, CASE WHEN c.event_id IS NULL THEN 'NONE' ELSE 'HIT' END AS result, c.event_id FROM {_KEYS} k LEFT JOIN c USING (user_id)",
    ),
    "full_get_fallthrough": (full_get_fallthrough, f"SELECT * FROM ({_LE.format('')}) WHERE event_type <> 'error'"),
    "bulk_miss": (bulk_miss, f"SELECT -user_id - 1 AS user_id, 'MISS' AS result FROM {_KEYS}"),
    "projected_get": (projected_get, f"SELECT user_id, value FROM ({_LE.format('')}) WHERE event_type <> 'error'"),
    "prefix_scan": (prefix_scan, _PAIRS.format("user_id = 7")),
    "range_scan": (range_scan, _PAIRS.format("user_id >= 10 AND (user_id < 20 OR user_id = 20 AND event_type < 'error')")),
    "lookup_join_left": (lookup_join_left, _ORDERS.format("LEFT")),
    "lookup_join_inner": (lookup_join_inner, _ORDERS.format("")),
    "lookup_join_extra_eq": (lookup_join_extra_eq, f"SELECT o_orderkey, o_custkey, c_name FROM orders JOIN {_DIM} ON o_custkey = c_custkey AND o_totalprice = last_price"),
    "delete_by_pk": (delete_by_pk, f"{_LIVE} AND user_id <> 7"),
    "changelog_kinds": (
        changelog_kinds, "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) NOT IN ('error', 'click')",
    ),
    "sink_base_state": (sink_base_state, _LIVE),
    "compact_invariance": (compact_invariance, _LIVE),
    "evict_invariance": (evict_invariance, _LIVE),
    "recovered_state": (recovered_state, _LIVE),
    "maintained_state": (maintained_state, _LIVE),
    "run_stats": (run_stats, _RUNS),
    "point_get": (point_get, _GOT),
    "run_point_get": (run_point_get, _GOT),
    "projected_point_get": (projected_point_get, f"SELECT user_id, value FROM ({_GOT})"),
    "local_get": (local_get, _HOT.format(_SOME_ROWS)),
    "bulk_local_get": (bulk_local_get, _HOT.format(_KEYS)),
    "bulk_get_pruned": (
        bulk_get_pruned,
        f"WITH c AS ({_LIVE}) SELECT k.user_id, CASE WHEN c.event_id IS NULL THEN 'NONE' ELSE 'HIT' END AS result, c.event_id FROM {_SOME_ROWS} k LEFT JOIN c USING (user_id)",
    ),
    "candidate_runs": (
        candidate_runs,
        f"SELECT k.user_id, CAST(part AS BIGINT) AS run FROM {_SOME_ROWS} k JOIN (SELECT part, min(user_id) AS a, max(user_id) AS b FROM {_FOURTHS} GROUP BY part) ON k.user_id BETWEEN a AND b",
    ),
    "key_only_range": (key_only_range, f"SELECT user_id FROM ({_LIVE}) WHERE user_id >= 10 AND user_id < 40"),
    "hot_cell_reads": (hot_cell_reads, _GOT),
    "repaired_reads": (repaired_reads, _GOT),
    "refreshed_reader": (refreshed_reader, _LIVE),
    "taken_over": (taken_over, _LIVE),
    "fresh_writer": (fresh_writer, f"SELECT user_id, event_id, event_type FROM ({_LE.format(f'WHERE event_id < {_TOP} * 1 // 2')}) WHERE event_type <> 'error'"),
    "fenced_sink": (fenced_sink, "SELECT n AS flush_fence, n AS sink_fence, n AS flushed_seq, n AS persisted_seq FROM (SELECT count(*) AS n FROM events)"),
    "state_counts": (
        state_counts,
        f"SELECT CAST(1 AS BIGINT) AS new_runs, count(DISTINCT CASE WHEN part = 2 THEN user_id END) AS new_rows, CAST(1 AS BIGINT) AS open_runs, "
        f"count(CASE WHEN part = 3 THEN 1 END) AS open_rows, count(*) + 1 AS next_seq, CAST(1 AS BIGINT) AS commits FROM {_FOURTHS}",
    ),
    "delete_predicate": (delete_predicate, f"{_LIVE} AND user_id <> 7"),
    "source_read": (source_read, _LIVE),
    "source_point_read": (source_point_read, f"SELECT * FROM ({_LE.format('')}) WHERE event_type <> 'error' AND user_id = 13"),
    "source_write": (source_write, _LIVE),
    "buffered_upserts": (buffered_upserts, "SELECT c_custkey, c_name FROM customer"),
    "http_lookups": (http_lookups, _GOT),
    "binary_lookups": (binary_lookups, _HOT.format(_SOME_ROWS)),
    "binary_writes": (binary_writes, "SELECT c_custkey, c_name FROM customer WHERE c_custkey <> 1"),
    "local_prefix": (local_prefix, _PAIRS.format(f"user_id = 7 AND event_id >= {_TOP} * 1 // 2")),
    "json_prefix": (json_prefix, _PAIRS.format("user_id = 7")),
    "lookup_null_keys": (
        lookup_null_keys, f"SELECT o_orderkey, c_name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS k FROM orders) LEFT JOIN {_DIM} ON k = c_custkey",
    ),
    "refused": (
        refused,
        "SELECT * FROM (VALUES ('put', 'OK'), ('part of a row', 'BAD_REQUEST'), ('null key', 'BAD_REQUEST'), ('unknown column', 'BAD_REQUEST'), ('unknown kind', 'BAD_REQUEST'), "
        "('too many rows', 'BAD_REQUEST'), ('delete of part', 'NOT_SUPPORTED'), ('delete of a value', 'NOT_SUPPORTED'), ('delete by another type', 'NOT_SUPPORTED'), "
        "('update before', 'OK'), ('prefix of all tiers', 'NOT_SUPPORTED'), ('lookup by part of a key', 'BAD_REQUEST'), ('lookup by a field', 'BAD_REQUEST'), "
        "('key column twice', 'BAD_REQUEST'), ('schema', 'SCHEMA_MISMATCH'), ('too many runs', 'OVERLOADED'), ('closed', 'SHUTTING_DOWN')) v(name, status)",
    ),
    "retried_calls": (retried_calls, "SELECT * FROM (VALUES ('passing', 3::BIGINT, 'OK'), ('lasting', 1::BIGINT, 'BAD_REQUEST')) v(name, calls, status)"),
    "call_metrics": (call_metrics, "SELECT CAST(11 AS BIGINT) AS gets, CAST(11 AS BIGINT) AS timed, count(*) AS rows_written FROM events"),
    "wire_rows": (wire_rows, "SELECT n_nationkey, n_name FROM nation"),
    "key_decode": (key_decode, "SELECT DISTINCT user_id, event_type FROM events"),
    "handshake": (
        handshake,
        "SELECT * FROM (VALUES ('user_id', 'bigint', 1::BIGINT), ('event_type', 'string', 2::BIGINT), ('event_id', 'bigint', 0::BIGINT), ('value', 'double', 0::BIGINT)) v(name, kind, key_place)",
    ),
    "option_defaults": (
        option_defaults,
        "SELECT name, CAST(value AS BIGINT) AS value FROM (VALUES ('freeze_rows', 1000000), ('freeze_bytes', 268435456), ('max_frozen', 4), ('max_new_runs', 20), ('visibility_seconds', 600), "
        "('new_run_cap', 10), ('sinked_run_cap', 10), ('sink_bytes', 1073741824), ('compact_bytes', 1073741824), ('hot_threshold', 3), ('hot_bytes', 3221225472)) v(name, value)",
    ),
    "status_codes": (
        status_codes,
        "SELECT * FROM (VALUES ('OK'), ('BAD_REQUEST'), ('OVERLOADED'), ('SCHEMA_MISMATCH'), ('SHUTTING_DOWN'), ('INTERNAL_ERROR'), ('LOOKUP_UNAVAILABLE')) v(status)",
    ),
    "sink_prefix_selection": (
        sink_prefix_selection,
        f"WITH r AS ({_RUNS}) SELECT 'most' AS case, entry_count, min_seq FROM r UNION ALL SELECT 'least', entry_count, min_seq FROM r WHERE min_seq = 1",
    ),
    "key_order": (
        key_order,
        "SELECT user_id, event_type, '06' || printf('%016X', CAST(user_id AS HUGEINT) + 9223372036854775808) || '01' || "
        "array_to_string(list_transform(range(0, strlen(event_type) // 8 + 1), lambda i: rpad(substr(hex(event_type), CAST(i * 16 + 1 AS INTEGER), 16), 16, '0') || "
        "printf('%02X', 255 - greatest(0, (i + 1) * 8 - strlen(event_type)))), '') AS key FROM (SELECT DISTINCT user_id, event_type FROM events)",
    ),
    "json_rows": (
        json_rows,
        "SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderdate\":' || epoch_ms(o_orderdate) || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS json FROM orders",
    ),
    "upsert_streaming": (upsert_streaming, _LIVE),
    "lookup_streaming": (lookup_streaming, _ORDERS.format("LEFT")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items()}
