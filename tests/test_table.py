import random

import pytest
from pyspark.sql import types as T

from tidemark.config import Options, retried
from tidemark.errors import BadRequest, LookupUnavailable, NotSupported, Overloaded, SchemaMismatch, ShuttingDown, WriterFenced
from tidemark.operators import lookup
from tidemark.operators.scheduler import Fences, compact_selection, decide, sink_selection
from tidemark.operators.table import Table
from tidemark.plans import storage
from tidemark.plans.manifest import FROZEN, NEW, OPEN, SINKED, Manifest, Run
from tidemark.service import Service
from tidemark.spec import TableSpec, columns

F1 = TableSpec(columns(id="int", marker="string"), ("id",))
F2 = TableSpec(columns(id="int", sub_id="int", marker="string"), ("id", "sub_id"))
F3 = TableSpec(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("marker", T.StringType(), False)]), ("id",))
DETAILS = T.StructType([T.StructField("required", T.StringType(), False), T.StructField("optional", T.IntegerType())])
F4 = TableSpec(
    T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("attributes", T.MapType(T.StringType(), T.IntegerType(), False), False), T.StructField("details", DETAILS, False),
        T.StructField("amount", T.DecimalType(38, 18), False),
    ]),
    ("id",),
)
F7 = TableSpec(columns(region="int", order_id="bigint", amount="int"), ("region", "order_id"), ("region",), 2)


@pytest.fixture
def make(spark, tmp_path):
    n = iter(range(1000))
    return lambda spec=F1, options=Options(): Table.create(spark, f"{tmp_path}/t{next(n)}", spec, options)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tiers_and_scan(make):
    t = make(TableSpec(T.StructType.fromDDL("k STRING, v STRING"), ("k",)))
    t.write_batch([("+I", {"k": "p/1", "v": "old-1"}), ("+I", {"k": "p/2", "v": "old-2"}), ("+I", {"k": "q/1", "v": "outside"})])
    t.sink_all()
    t.write_batch([("+I", {"k": "p/1", "v": "new-1"}), ("-D", {"k": "p/2"}), ("+I", {"k": "p/3", "v": "new-3"})])
    t.flush_all()
    t.put(k="p/4", v="cur-4")
    assert [tuple(r) for r in lookup.scan(t, {"k": "p/"}, {"k": "p0"}).collect()] == [("p/1", "new-1"), ("p/3", "new-3"), ("p/4", "cur-4")]
    assert lookup.scan(t, {"k": "q"}, {"k": "p"}).collect() == []
    assert [r.k for r in lookup.scan(t, {"k": "p/3"}, {"k": "p/4"}).collect()] == ["p/3"]


def test_tristate_and_empty_value_is_live(make):
    t = make()
    t.put(id=1, marker="")
    t.delete(id=2)
    assert lookup.get_local(t, {"id": 1}) == ("HIT", t.current().first())
    assert lookup.get_local(t, {"id": 2}) == ("DELETED", None)
    assert lookup.get_local(t, {"id": 3}) == ("MISS", None)


def test_tombstone_blocks_base(make):
    t = make()
    t.put(id=1, marker="base-a")
    t.sink_all()
    t.evict()
    t.delete(id=1)
    assert lookup.get(t, {"id": 1}) is None
    assert lookup.get_local(t, {"id": 1})[0] == "DELETED"
    assert rows(t.base()) == [(1, "base-a")]
    t.sink_all()
    assert rows(t.base()) == [] and rows(t.current()) == []


def test_last_of_a_batch_wins(make):
    t = make()
    assert t.write_batch([("+I", {"id": 1, "marker": "a"}), ("-D", {"id": 1}), ("+I", {"id": 1, "marker": "b"})]) == 3
    assert rows(t.current()) == [(1, "b")]


def test_fresh_writer_over_a_base(make, spark):
    t = make()
    t.write_batch([("+I", {"id": 1, "marker": "old"}), ("+I", {"id": 2, "marker": "delete-me"}), ("+I", {"id": 3, "marker": "keep"})])
    t.sink_all()
    t = Table.open(spark, t.store.root, fresh_writer=True)
    assert t.m.next_seq == 1
    t.write_batch([("+U", {"id": 1, "marker": "updated"}), ("-D", {"id": 2}), ("+I", {"id": 4, "marker": "inserted"})])
    want = [(1, "updated"), (3, "keep"), (4, "inserted")]
    assert rows(t.current()) == want
    t.sink_all()
    assert rows(t.base()) == want


def test_prefix(make):
    t = make(F2)
    t.write_batch([("+I", {"id": 1, "sub_id": s, "marker": f"old-{s}"}) for s in (1, 2)] + [("+I", {"id": 2, "sub_id": 1, "marker": "x"})])
    t.flush_all()
    t.write_batch([("+U", {"id": 1, "sub_id": 1, "marker": "new-1"}), ("-D", {"id": 1, "sub_id": 2}), ("+I", {"id": 1, "sub_id": 3, "marker": "cur-3"})])
    want = [(1, 1, "new-1"), (1, 3, "cur-3")]
    assert [tuple(r) for r in lookup.prefix_local(t, {"id": 1})] == want == [tuple(r) for r in lookup.prefix(t, {"id": 1})]
    with pytest.raises(Overloaded):
        lookup.prefix_local(t, {"id": 1}, limit=1)
    for bad in ({"sub_id": 1}, {}, {"marker": "x"}, {"id": None}):
        with pytest.raises(BadRequest):
            lookup.prefix_local(t, bad)


def test_upsert_lookup_delete(make, spark):
    t = make()
    t.write_batch([("+I", {"id": 1, "marker": "old"}), ("+I", {"id": 2, "marker": "second"}), ("+U", {"id": 1, "marker": "latest"})])
    facts = spark.createDataFrame([(10, 1), (11, 99), (12, None)], "o int, k int")
    got = lookup.lookup_join(facts, t, {"k": "id"}, columns=["marker"])
    assert sorted((r.o, r.marker) for r in got.collect()) == [(10, "latest"), (11, None), (12, None)]
    assert rows(lookup.lookup_join(facts, t, {"k": "id"}, "inner", columns=["marker"])) == [(10, 1, "latest")]
    t.delete_where(lookup.delete_predicate(F1, [("id", 1)]))
    t.sink_all()
    assert rows(t.base()) == [(2, "second")]


def test_lookup_join_refuses(make, spark):
    t = make(F2)
    facts = spark.createDataFrame([(1, 2, "x")], "a int, b int, m string")
    for on, extra in (({"a": "id"}, None), ({"a": "id", "b": "id"}, None), ({"a": "id", "b": "sub_id"}, {"m": "id"}), ({"a": "id", "b.x": "sub_id"}, None)):
        with pytest.raises(BadRequest):
            lookup.lookup_join(facts, t, on, extra=extra)
    t.put(id=2, sub_id=1, marker="x")
    assert lookup.lookup_join(facts, t, {"b": "id", "a": "sub_id"}, "inner", {"m": "marker"}).count() == 1


def test_delete_predicates():
    assert lookup.delete_predicate(F2, [("sub_id", 2), ("id", 1)]) == {"id": 1, "sub_id": 2}
    for bad in ([("id", 1)], [("id", 1), ("id", 1)], [("id", 1), ("marker", "x")], [("id", "1"), ("sub_id", 2)], [("id", None), ("sub_id", 2)]):
        with pytest.raises(NotSupported):
            lookup.delete_predicate(F2, bad)


def test_bulk_lookup(make, spark):
    t = make()
    t.write_batch([("+I", {"id": i, "marker": f"b{i}"}) for i in range(10)])
    t.sink_all()
    t.evict()
    t.write_batch([("+U", {"id": 1, "marker": "hot"}), ("-D", {"id": 2})])
    keys = spark.createDataFrame([(i,) for i in (1, 2, 3, 42)], "id int")
    assert rows(lookup.get_many(t, keys)) == [(1, "HIT", "hot"), (2, "DELETED", None), (3, "HIT", "b3"), (42, "MISS", None)]
    assert rows(lookup.get_many(t, keys, local=True)) == [(1, "HIT", "hot"), (2, "DELETED", None), (3, "MISS", None), (42, "MISS", None)]


def test_partitions_and_buckets(make):
    t = make(F7)
    t.write_batch([("+I", {"region": r, "order_id": o, "amount": r * o}) for r in (1, 2) for o in range(20)])
    t.sink_all()
    t.evict()
    assert len(t.m.base) == 4
    assert lookup.get(t, {"region": 2, "order_id": 7}).amount == 14 and lookup.get(t, {"region": 1, "order_id": 7}, ["amount"]) == (7,)
    assert len(t.cells_below({"region": 1})) == 2 and t.cells_below({}) is None
    assert [r.order_id for r in lookup.prefix(t, {"region": 2})] == list(range(20))
    before = dict(t.m.base)
    t.put(region=1, order_id=3, amount=-1)
    t.sink_all()
    assert sum(before[c] != t.m.base[c] for c in before) == 1  # one cell is written anew
    t.vacuum()
    assert t.current().count() == 40 and lookup.get(t, {"region": 1, "order_id": 3}).amount == -1


def test_complex_values_and_not_null_deletes(make):
    from decimal import Decimal

    t = make(F4)
    row = {"id": 1, "items": ["a"], "attributes": {"x": 1}, "details": ("r", None), "amount": Decimal("1.5")}
    t.write_batch([("+I", row), ("+I", row | {"id": 2})])
    t.delete(id=2)
    t.sink_all()
    got = t.base().collect()
    assert len(got) == 1 and got[0].items == ["a"] and got[0].details.required == "r"
    with pytest.raises(BadRequest):
        t.put(id=3, items=None, attributes={}, details=("r", 1), amount=Decimal(1))
    t3 = make(F3)
    t3.put(id=1, marker="x")
    t3.delete(id=1)
    assert rows(t3.current()) == []


def test_bad_batches_write_nothing(make):
    t = make(options=Options(max_batch_rows=2))
    for bad in ([], [("+I", {"id": i, "marker": ""}) for i in range(3)], [("?", {"id": 1})], [("+I", {"id": None, "marker": "x"})], [("+I", {"id": 1, "other": 2})]):
        with pytest.raises(BadRequest):
            t.write_batch(bad)
    with pytest.raises(BadRequest):
        t.delete_where({"id": 1, "marker": "x"})
    assert t.m.next_seq == 1 and rows(t.current()) == []


def test_specifications(spark):
    ddl = T.StructType.fromDDL
    for schema, key, parts in (("id INT", (), ()), ("id INT, d STRING", ("id",), ("d",)), ("id BINARY", ("id",), ()), ("id BOOLEAN", ("id",), ()), ("id INT, v INTERVAL DAY TO SECOND", ("id",), ()), ("id INT, _seq INT", ("id",), ())):
        with pytest.raises(BadRequest):
            TableSpec(ddl(schema), key, parts)
    F1.check_same(TableSpec(ddl("id INT, marker STRING"), ("id",)))
    for other in (F2, F3, TableSpec(ddl("id BIGINT, marker STRING"), ("id",))):
        with pytest.raises(SchemaMismatch):
            F1.check_same(other)
    assert TableSpec.from_json(F7.to_json()).fingerprint() == F7.fingerprint() != F1.fingerprint()


def test_open_checks(make, spark, tmp_path):
    t = make()
    with pytest.raises(SchemaMismatch):
        Table.open(spark, t.store.root, F2)
    with pytest.raises(BadRequest):
        Table.open(spark, f"{tmp_path}/none")


def test_recovery_at_each_step(make, spark):
    t = make()
    t.put(id=1, marker="a")
    t = Table.open(spark, t.store.root)  # written, not frozen
    assert rows(t.current()) == [(1, "a")] and t.fences.recovered
    t.flush_all()
    t = Table.open(spark, t.store.root)  # flushed
    assert rows(t.current()) == [(1, "a")]
    t.prepare_sink()
    t = Table.open(spark, t.store.root)  # prepared: finished on opening
    assert t.m.prepared is None and rows(t.base()) == [(1, "a")] and t.m.persisted_seq == 1
    assert not t.commit_sink()
    t.put(id=2, marker="b")
    t.flush_all()
    p = t.prepare_sink()
    t.store.delete("base", p["folder"])
    with pytest.raises(LookupUnavailable):
        Table.open(spark, t.store.root)


def test_missing_files_are_no_miss(make):
    t = make()
    t.put(id=1, marker="a")
    t.sink_all()
    t.evict()
    t.store.delete("base", next(iter(t.m.base.values())))
    with pytest.raises(LookupUnavailable):
        lookup.get(t, {"id": 1})


def test_admission(make):
    t = make(options=Options(max_frozen=1))
    t.put(id=1, marker="a")
    t.freeze()
    with pytest.raises(Overloaded):
        t.put(id=2, marker="b")
    t.flush()
    t.put(id=2, marker="b")
    t.close()
    with pytest.raises(ShuttingDown):
        t.put(id=3, marker="c")


def test_a_whole_batch_is_written_and_then_frozen_at_the_limit(make):
    t = make(options=Options(freeze_rows=3))
    t.write_batch([("+I", {"id": i, "marker": "a"}) for i in range(2)])
    assert [r.state for r in t.m.runs] == [OPEN]
    t.write_batch([("+I", {"id": i, "marker": "b"}) for i in range(2)])
    assert [(r.state, r.rows) for r in t.m.runs] == [(FROZEN, 2), (FROZEN, 2)]


def test_second_writer_is_noticed(make, spark):
    t = make()
    other = Table.open(spark, t.store.root)
    t.put(id=1, marker="a")
    with pytest.raises(Exception, match="another writer"):
        other.put(id=1, marker="b")


def test_streams_skip_written_batches(make, spark):
    t = make()
    df = spark.createDataFrame([(1, "a")], "id int, marker string")
    t.append(df, stream="s", batch_id=0)
    t.append(df, stream="s", batch_id=0)
    assert t.m.next_seq == 2


def test_hot_cells_stay_in_memory(make):
    t = make(options=Options(hot_threshold=2))
    t.put(id=1, marker="a")
    t.sink_all()
    t.evict()
    for _ in range(4):
        assert lookup.get(t, {"id": 1}).marker == "a"
    assert len(t.kept) == 1
    t.put(id=1, marker="b")
    t.sink_all()
    t.evict()
    assert not t.kept and lookup.get(t, {"id": 1}).marker == "b"


def test_random_histories(make, spark):
    rng = random.Random(24301)
    t = make(TableSpec(F1.schema, ("id",), buckets=3), Options(new_run_cap=2, sinked_run_cap=1))
    model: dict[int, str] = {}
    for step in range(25):
        ops = []
        for _ in range(rng.randint(1, 6)):
            i = rng.randrange(8)
            if rng.random() < 0.3:
                ops.append(("-D", {"id": i}))
                model.pop(i, None)
            else:
                ops.append(("+I", {"id": i, "marker": f"{step}"}))
                model[i] = f"{step}"
        t.write_batch(ops)
        for call in rng.sample([t.freeze, t.flush, t.compact, t.sink, t.evict, t.maintain, lambda: t.compact(state=SINKED)], 3):
            call()
        if rng.random() < 0.2:
            t = Table.open(spark, t.store.root, options=t.options)
        assert rows(t.current()) == sorted(model.items()), step


def test_deterministic_history(make):
    t = make(TableSpec(T.StructType.fromDDL("id BIGINT, payload STRING, version INT"), ("id",)))
    t.write_batch([("+I", {"id": i, "payload": f"p{i}", "version": 0}) for i in range(100)])
    t.flush_all()
    t.write_batch([("+U", {"id": i, "payload": f"q{i}", "version": 1}) for i in range(0, 100, 5)])
    t.write_batch([("-D", {"id": i}) for i in range(3, 100, 11)])
    t.sink_all()
    want = [(i, f"q{i}" if i % 5 == 0 else f"p{i}", int(i % 5 == 0)) for i in range(100) if i % 11 != 3]
    assert rows(t.base()) == want


def run(i, state, a, b, size=10, written=0.0):
    return Run(f"r{i}", state, i, i, a, b, b - a + 1, size, written)


def test_selections():
    m = Manifest(runs=[run(0, NEW, 1, 5), run(1, NEW, 6, 9), run(2, NEW, 10, 20, 100)], flushed_seq=20)
    assert [r.id for r in sink_selection(m, 9, 1000)] == ["r0", "r1"]
    assert [r.id for r in sink_selection(m, 20, 15)] == ["r0"]
    assert [r.id for r in sink_selection(m, 20, 1)] == ["r0"]
    with pytest.raises(ValueError, match="crosses"):
        sink_selection(m, 7, 1000)
    assert [r.id for r in compact_selection(m, NEW, 50)] == ["r0", "r1"]
    assert compact_selection(m, NEW, 5) == []


def test_decisions():
    o, f = Options(new_run_cap=1, sinked_run_cap=1, compact_bytes=5), Fences()
    assert decide(Manifest(), o, f, 0).kind == "none"
    assert decide(Manifest(prepared={"runs": ["x"]}), o, f, 0).kind == "resume"
    assert decide(Manifest(runs=[run(0, OPEN, 1, 2)]), o, Fences(flush=2), 0).kind == "freeze"
    assert decide(Manifest(runs=[run(0, FROZEN, 1, 2)], frozen_seq=2), o, Fences(flush=2), 0).kind == "flush"
    assert decide(Manifest(runs=[run(0, NEW, 1, 2)], frozen_seq=2, flushed_seq=2), o, Fences(sink=2), 0).kind == "sink"
    assert decide(Manifest(runs=[run(0, NEW, 1, 2)], frozen_seq=2, flushed_seq=2), o, Fences(flush=2), 0).kind == "none"
    assert decide(Manifest(runs=[run(0, NEW, 1, 2)], frozen_seq=2, flushed_seq=2), o, f, 600).kind == "sink"
    assert decide(Manifest(runs=[run(0, NEW, 1, 2)], frozen_seq=2, flushed_seq=2), o, Fences(recovered=True), 0).kind == "sink"
    two = [run(0, NEW, 1, 2), run(1, NEW, 3, 4)]
    assert decide(Manifest(runs=two, flushed_seq=4), o, f, 0).kind == "sink"
    assert decide(Manifest(runs=two, flushed_seq=4), Options(new_run_cap=1), f, 0).kind == "compact"
    done = [run(0, SINKED, 1, 2), run(1, SINKED, 3, 4)]
    assert decide(Manifest(runs=done), o, f, 0).kind == "evict"
    assert decide(Manifest(runs=done), Options(sinked_run_cap=1), f, 0).kind == "compact"


def test_retries():
    calls, waits = [], []

    def fails(error):
        def call():
            calls.append(1)
            raise error
        return call

    with pytest.raises(Overloaded):
        retried(fails(Overloaded("x")), sleep=waits.append)
    assert len(calls) == 4 and waits == [0.01, 0.02, 0.04]
    calls.clear()
    with pytest.raises(BadRequest):
        retried(fails(BadRequest("x")), sleep=waits.append)
    assert len(calls) == 1


def test_service(make):
    s = Service(make(F2))
    assert s.write({"id": 1, "sub_id": 2, "marker": "a", "ignored": 1}) == {"sequence": 1}
    assert s.get({"id": 1, "sub_id": 2}) == {"id": 1, "sub_id": 2, "marker": "a"}
    assert s.get_local({"id": 1, "sub_id": 3}) == {"result": "MISS", "row": None}
    assert s.call("prefix_local", {"sub_id": 2})["status"] == "BAD_REQUEST"
    assert s.call("delete", {"id": 1, "sub_id": 2})["status"] == "OK" and s.get({"id": 1, "sub_id": 2}) is None
    assert s.flush() == {"fence": 2} and s.sink() == {"fence": 2}
    s.table.maintain()
    assert s.state()["persisted_seq"] == 2 and s.health() == {"status": "OK"}


def test_service_reads_whole_prefixes(make):
    s = Service(make(F2, Options(max_prefix_results=2)))
    own = [{"id": 1, "sub_id": i, "marker": "a"} for i in range(4)]
    s.write_batch([{"kind": "+I", "row": r} for r in own])
    assert s.prefix_local({"id": 1}) == own
    assert s.call("prefix", {"id": 1})["status"] == Overloaded.status


def opened(df):
    """Base cells whose files a plan opens."""
    return {f.rpartition("/")[0] for f in df.inputFiles() if "/base/" in f}


def test_bulk_lookup_opens_only_the_cells_of_its_keys(make, spark):
    t = make(TableSpec(F1.schema, ("id",), buckets=64))
    t.append(spark.range(2000).selectExpr("cast(id AS int) AS id", "concat('m', id) AS marker"))
    t.sink_all()
    t.evict()
    t.write_batch([("-D", {"id": 7}), ("+I", {"id": 2500, "marker": "hot"})])
    keys = spark.createDataFrame([(3,), (7,), (2500,), (9000,), (3,), (None,)], "id int")
    got = lookup.get_many(t, keys)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(3, "HIT", "m3"), (3, "HIT", "m3"), (7, "DELETED", None), (2500, "HIT", "hot"), (9000, "MISS", None), (None, "MISS", None)], key=repr)
    assert len(t.m.base) == 64 and 1 <= len(opened(got)) <= 4
    joined = lookup.lookup_join(keys.withColumnRenamed("id", "k"), t, {"k": "id"}, prune=True)
    assert sorted(map(tuple, joined.select("k", "marker").collect()), key=repr) == sorted([(3, "m3"), (3, "m3"), (7, None), (2500, "hot"), (9000, None), (None, None)], key=repr)
    assert len(opened(joined)) <= 5
    with pytest.raises(BadRequest):
        lookup.get_many(t, keys.selectExpr("id", "'x' AS marker"))


def test_cells_are_found_without_a_job(make, spark):
    spec = TableSpec(columns(p="string", d="date", k="bigint", v="string"), ("p", "d", "k"), ("p", "d"), 7)
    t = make(spec)
    import datetime as dt

    keys = [(p, dt.date(2024, 1, i + 1), k) for i, p in enumerate(["a", 'q"\\', "é", "", "x/y"]) for k in (0, -5, 1 << 40)] + [("tab\t", dt.date(2024, 1, 1), 1)]
    df = spark.createDataFrame([(*k, "v") for k in keys], spec.schema)
    want = {(r.p, r.d, r.k): r.cell for r in df.select("p", "d", "k", t._cell().alias("cell")).collect()}
    assert {k: t.cell_of(dict(zip(("p", "d", "k"), k, strict=True))) for k in keys} == want
    assert t._partition_of({"p": "tab\t", "d": dt.date(2024, 1, 1)}) is None  # left to Spark


def test_runs_are_left_out_by_their_keys(make):
    t = make()
    for a in (0, 10, 20):
        t.write_batch([("+I", {"id": a + i, "marker": "x"}) for i in range(5)])
        t.flush_all()
    assert [len(t.runs_within((v, v))) for v in (3, 7, 12, 99)] == [1, 0, 1, 0] and len(t.runs_within((4, 20))) == 3 and len(t.runs_within((None, 3))) == 1
    assert len(lookup.scan(t, {"id": 3}, {"id": 12}).inputFiles()) == 2
    assert lookup.get(t, {"id": 7}) is None and lookup.get(t, {"id": 12}).marker == "x" and lookup.get_local(t, {"id": 99}) == ("MISS", None)
    t.compact()
    assert [len(t.runs_within((v, v))) for v in (3, 7, 99)] == [1, 1, 0]


def test_batches_of_many_partitions_are_written_once(make, spark):
    t = make()
    t.put(id=0, marker="first")
    df = spark.range(1000).selectExpr("cast(id % 100 AS int) AS id", "concat('m', id) AS marker", "id AS n").repartition(7)
    assert t.append(df, order_by=("n",)) == 1001
    assert len(t.store.names("hot")) == 2 == len(t.m.runs) and (t.m.runs[1].min_seq, t.m.runs[1].max_seq, t.m.runs[1].rows) == (2, 1001, 1000)
    assert sorted(r[0] for r in t._runs(t.m.runs[1:]).select("_seq").collect()) == list(range(2, 1002))
    assert rows(t.current()) == [(i, f"m{900 + i}") for i in range(100)]
    assert (t.m.runs[1].min_key, t.m.runs[1].max_key) == ([0], [99])
    assert t.append(df.limit(0).drop("n")) == 1001 and len(t.m.runs) == 2


def test_large_cells_are_written_by_several_tasks(make, spark):
    t = make(options=Options(cell_task_bytes=1000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which brings small slices together
    try:
        for _ in range(2):
            t.append(spark.range(3000).selectExpr("cast(id AS int) AS id", "concat('m', id) AS marker"))
            t.sink_all()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (folder,) = t.m.base.values()
    files = t.store.files("base", folder)
    assert len(files) > 1 and t.m.base_bytes == sum(files.values()) == sum(t.m.base_sizes.values())
    assert t.current().count() == 3000 and t.store.names("work") == []


def test_a_new_writer_fences_the_old_one(make, spark):
    t = make()
    t.put(id=1, marker="a")
    other = Table.open(spark, t.store.root, take_over=True)
    assert other.m.writer_id != t.m.writer_id
    for call in (lambda: t.put(id=1, marker="b"), t.freeze, t.sink_all):
        with pytest.raises(WriterFenced):
            call()
    other.put(id=2, marker="c")
    assert rows(other.current()) == [(1, "a"), (2, "c")]


def test_a_claim_left_behind_does_not_stop_the_table(make, monkeypatch):
    t = make()
    with open(f"{t.store.root}/manifest/{t.m.version + 1:012d}.json.claim", "w"):
        pass
    with pytest.raises(WriterFenced):
        t.store.write_json({}, "manifest", f"{t.m.version + 1:012d}.json")
    monkeypatch.setattr(storage, "CLAIM_SECONDS", -60)
    t.put(id=1, marker="a")
    assert rows(t.current()) == [(1, "a")] and not [n for n in t.store.names("manifest") if not n.endswith(".json")]


def test_compaction_windows_match_brute_force():
    rng = random.Random(7)
    for _ in range(500):
        at, runs = 0, []
        for i in range(rng.randint(0, 8)):
            at += rng.choice([1, 1, 1, 2])
            runs.append(Run(f"r{i}", rng.choice([NEW, NEW, NEW, SINKED]), at, at, i, i, 1, rng.randint(0, 20), 0.0))
        m = Manifest(runs=runs, prepared={"runs": rng.sample([r.id for r in runs], min(len(runs), rng.choice([0, 0, 1])))} if rng.random() < 0.5 else None)
        held, own, most = set((m.prepared or {}).get("runs", ())), [r for r in runs if r.state == NEW], rng.randint(0, 60)
        fits = lambda w: sum(r.bytes for r in w) <= most and not held & {r.id for r in w} and all(b.flush_from == a.flush_to + 1 for a, b in zip(w, w[1:], strict=False))  # noqa: B023, E731
        want: list = []
        for i in range(len(own)):
            ends = [j for j in range(i + 2, len(own) + 1) if fits(own[i:j])]
            if ends:
                want = own[i : max(ends)]
                break
        assert compact_selection(m, NEW, most) == want


def test_metrics(make):
    t = make()
    t.put(id=1, marker="a")
    lookup.get(t, {"id": 1})
    with pytest.raises(BadRequest):
        lookup.get(t, {"x": 1})
    s = t.state()["metrics"]
    assert s["get"] == 1 and s["rows_written"] == 1 and sum(s["get_ms"].values()) == 1
