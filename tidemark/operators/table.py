"""Current-state tables: writing, the life of runs, the sink and recovery.

Layers, new to old: OPEN batches, FROZEN batches, NEW runs, SINKED runs, base.
The first four are the hot tier: changes with a sequence of this writer. The
base has one row a key, in folders by partition and bucket (cells); a sink
rewrites only the cells that its changes touch. The hot tier always hides the
base, whatever the sequences, so a fresh writer may start again at 1.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Options
from tidemark.errors import BadRequest, LookupUnavailable, Overloaded, ShuttingDown, TidemarkError, WriterFenced
from tidemark.functions.changelog import DELETES, PUTS, changes, ordered
from tidemark.functions.hashing import cast, xxhash64
from tidemark.metrics import Metrics
from tidemark.plans import manifest as mf
from tidemark.plans.manifest import FROZEN, NEW, OPEN, SINKED, Manifest, Run
from tidemark.plans.merge import latest, live, overlay
from tidemark.plans.storage import Store
from tidemark.spec import TableSpec

from .scheduler import Action, Fences, compact_selection, decide, sink_selection


class Table:
    """One table, one writer. Every change publishes a manifest version; every
    read builds a DataFrame over the version that it loads."""

    def __init__(self, store: Store, spec: TableSpec, options: Options, m: Manifest):
        self.store, self.spec, self.options, self.m = store, spec, options, m
        self.spark = store.spark
        self.fences = Fences(recovered=bool(m.of(OPEN, FROZEN, NEW)))
        self.closed = False
        self.reads: dict[str, int] = {}
        self.kept: dict[str, tuple[DataFrame, int]] = {}
        self.metrics = Metrics()

    # -- opening ---------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: TableSpec, options: Options = Options()) -> Table:
        store = Store(spark, path)
        store.write_json(spec.to_json() | {"fingerprint": spec.fingerprint()}, "table.json")
        return cls(store, spec, options, mf.publish(store, Manifest()))

    @classmethod
    def open(cls, spark: SparkSession, path: str, spec: TableSpec | None = None, options: Options = Options(), fresh_writer: bool = False, take_over: bool = False) -> Table:
        """Open for reading and writing; a sink that stopped between its phases
        is finished. ``fresh_writer``: forget the hot tier, keep the base (a new
        writer for an existing base, with sequences from 1). ``take_over``: be a new
        writer of all that is there; the one before cannot publish any more."""
        store = Store(spark, path)
        if not store.exists("table.json"):
            raise BadRequest(f"no table at {path}")
        d = store.read_json("table.json")
        own = TableSpec.from_json(d)
        if own.fingerprint() != d["fingerprint"]:
            raise BadRequest("table.json does not have its fingerprint")
        if spec is not None:
            own.check_same(spec)
        m = mf.load(store)
        if m is None:
            m = mf.publish(store, Manifest())
        if fresh_writer:
            m = mf.publish(store, Manifest(version=m.version, base=m.base, base_sizes=m.base_sizes, commits=m.commits))
        elif take_over:
            m.writer_id = uuid.uuid4().hex
            m = mf.publish(store, m)
        table = cls(store, own, options, m)
        if m.prepared:
            table.resume_sink()
        return table

    def close(self) -> None:
        """Refuse further writes. What is written stays where it is."""
        self.closed = True
        for df, _ in self.kept.values():
            df.unpersist()
        self.kept.clear()

    def refresh(self) -> Table:
        self.m = mf.load(self.store) or self.m
        return self

    def _publish(self) -> None:
        """The next version, if this is still the writer of the last one."""
        last = mf.load(self.store)
        if last is not None and (last.writer_id != self.m.writer_id or last.version != self.m.version):
            raise WriterFenced(f"version {last.version} is of writer {last.writer_id}, this one is at {self.m.version}: another writer has this table")
        self.m = mf.publish(self.store, self.m)

    # -- writing ---------------------------------------------------------

    def _admit(self) -> None:
        if self.closed:
            raise ShuttingDown("the table is closed")
        groups = len({r.flush_from for r in self.m.of(FROZEN)})
        if groups >= self.options.max_frozen or len(self.m.of(NEW)) >= self.options.max_new_runs:
            raise Overloaded(f"{groups} frozen groups and {len(self.m.of(NEW))} runs wait for maintenance")

    def append(self, df: DataFrame, kind_col: str | None = None, order_by: Iterable[str] = (), stream: str | None = None, batch_id: int | None = None) -> int:
        """Write a changelog batch; returns the last sequence. A batch of a
        stream that is there already is skipped, so a retried micro-batch is harmless."""
        self._admit()
        if stream is not None and batch_id is not None and self.m.batches.get(stream, -1) >= batch_id:
            return self.m.next_seq - 1
        rows = ordered(df, self.spec, kind_col, tuple(order_by)).persist(StorageLevel.MEMORY_AND_DISK)  # counted, then written
        try:
            counts = rows.groupBy(F.shiftright("_place", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a partition
            starts, at = [], self.m.next_seq
            for r in counts:
                starts.append((r["p"], at))
                at += r["n"]
            if starts:
                stored = changes(rows, self.spec, self.spark.createDataFrame(starts, "_part long, _start long"), kind_col)
                run = self._write(stored, f"b-{uuid.uuid4().hex}", OPEN, self.m.flushes, self.m.flushes)
                if (run.rows, run.min_seq, run.max_seq) != (at - self.m.next_seq, self.m.next_seq, at - 1):
                    raise TidemarkError("the batch gave other rows when it was read again")
                self.m.runs.append(run)
                self.m.next_seq = at
        finally:
            rows.unpersist()
        if stream is not None and batch_id is not None:
            self.m.batches[stream] = batch_id
        self._publish()
        self.metrics.add("rows_written", at - starts[0][1] if starts else 0)
        waiting = self.m.of(OPEN)
        if sum(r.rows for r in waiting) >= self.options.freeze_rows or sum(r.bytes for r in waiting) >= self.options.freeze_bytes:
            self.freeze()
        return self.m.next_seq - 1

    def write_batch(self, ops: Iterable[tuple[str, Mapping]]) -> int:
        """Changes as (kind, row) in order: +I and +U put a whole row, -D and -U
        delete its key. All are checked before anything is written; sequences are contiguous."""
        ops = list(ops)
        if not 1 <= len(ops) <= self.options.max_batch_rows:
            raise BadRequest(f"a batch has 1 to {self.options.max_batch_rows} changes")
        rows = []
        for i, (kind, row) in enumerate(ops):
            if kind not in (*PUTS, *DELETES):
                raise BadRequest(f"unknown change kind: {kind}")
            if unknown := set(row) - set(self.spec.columns):
                raise BadRequest(f"unknown columns: {sorted(unknown)}")
            if any(row.get(c) is None for c in self.spec.primary_key):
                raise BadRequest(f"change {i} has a null in its key")
            if kind in PUTS and (bad := [f.name for f in self.spec.schema.fields if not f.nullable and row.get(f.name) is None]):
                raise BadRequest(f"change {i} has nulls in {bad}")
            rows.append((*(row.get(c) if kind in PUTS or c in self.spec.primary_key else None for c in self.spec.columns), kind, i))
        schema = self.spec.stored()
        fields = [f.dataType.simpleString() for f in schema.fields if not f.name.startswith("_")]
        ddl = ", ".join(f"`{c}` {t}" for c, t in zip(self.spec.columns, fields, strict=True))
        df = self.spark.createDataFrame(rows, f"{ddl}, _kind string, _op int").coalesce(1).sortWithinPartitions("_op").drop("_op")
        return self.append(df, "_kind")

    def put(self, **row) -> int:
        return self.write_batch([("+I", row)])

    def delete(self, **key) -> int:
        """Delete by whole key; a key that is absent is no error."""
        return self.delete_where(key)

    def delete_where(self, equal: Mapping) -> int:
        """DELETE ... WHERE: equalities with literals on exactly the key columns, blindly. Anything else is refused."""
        if set(equal) != set(self.spec.primary_key) or len(list(equal)) != len(self.spec.primary_key):
            raise BadRequest("a delete needs each key column once, and nothing else")
        if any(v is None for v in equal.values()):
            raise BadRequest("a delete needs literals that are not null")
        return self.write_batch([("-D", dict(equal))])

    # -- reading ---------------------------------------------------------

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.spec.stored()).parquet(*paths)

    def _runs(self, runs: Iterable[Run], columns: Iterable[str] | None = None) -> DataFrame:
        runs = list(runs)
        paths = [self.store.at("hot", r.id) for r in runs if not r.shift]
        df = self._read(*paths) if paths else self.spark.createDataFrame([], self.spec.stored())
        if moved := [(r.id, r.shift) for r in runs if r.shift]:  # written by tasks that did not know where they begin
            by = self.spark.createDataFrame(moved, "_run string, _shift long")
            read = self._read(*(self.store.at("hot", i) for i, _ in moved)).withColumn("_run", F.regexp_extract("_metadata.file_path", "/hot/([^/]+)/", 1))
            read = read.join(F.broadcast(by), "_run").withColumn("_seq", F.col("_seq") + F.col("_shift")).select(*self.spec.stored().fieldNames())
            df = df.unionByName(read) if paths else read
        return df if columns is None else df.select(*dict.fromkeys([*self.spec.primary_key, *columns, "_seq", "_deleted"]))

    def hot(self, columns: Iterable[str] | None = None, where: Column | None = None, first: tuple[object, object] | None = None) -> DataFrame:
        """The latest change of each hot key, deletes included; ``where`` is on key
        columns, ``first`` bounds the first one: runs that end before or begin after are not opened."""
        df = self._runs(self.runs_within(first), columns)
        return latest(df if where is None else df.where(where), self.spec.primary_key)

    def runs_within(self, first: tuple[object, object] | None) -> list[Run]:
        """Runs that may have keys whose first column is from first[0] to first[1] (None: no bound)."""
        kind = self.spec.schema[self.spec.primary_key[0]].dataType
        if first is None or not isinstance(kind, (T.IntegerType, T.LongType, T.StringType)):
            return self.m.runs
        low, high = (v if v is None else cast(v, kind) for v in first)
        out = []
        for r in self.m.runs:
            if r.min_key and r.max_key and (low is not None and r.max_key[0] < low or high is not None and r.min_key[0] > high):
                continue
            out.append(r)
        return out

    def base(self, cells: Iterable[str] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """Rows of the base, of all cells or just of some."""
        names = [c for c in (self.m.base if cells is None else cells) if c in self.m.base]
        schema = self.spec.schema
        parts: list[DataFrame] = []
        plain = []
        for c in names:
            (parts if c in self.kept else plain).append(self.kept[c][0] if c in self.kept else self.store.at("base", self.m.base[c]))  # type: ignore[arg-type]
        df = self.spark.read.schema(schema).parquet(*plain) if plain else self.spark.createDataFrame([], schema)
        for p in parts:
            df = df.unionByName(p)
        return df if columns is None else df.select(*dict.fromkeys([*self.spec.primary_key, *columns]))

    def current(
        self, columns: Iterable[str] | None = None, where: Column | None = None, cells: Iterable[str] | None = None, first: tuple[object, object] | None = None
    ) -> DataFrame:
        """The current rows. ``where`` (on key columns) goes below the merge."""
        columns = list(self.spec.columns if columns is None else columns)
        base = self.base(cells, columns)
        if where is not None:
            base = base.where(where)
        runs = self.runs_within(first)
        if not runs:
            return base.select(*columns)
        small = sum(r.bytes for r in runs) <= self.options.key_broadcast_bytes
        return overlay(base, self.hot(columns, where, first), self.spec.primary_key, small).select(*columns)

    def cell_of(self, key: Mapping) -> str:
        """Cell of a whole key; without a job where its values are of the columns' own types."""
        kinds = {f.name: f.dataType for f in self.spec.schema.fields}
        own = {c: cast(key[c], kinds[c]) for c in self.spec.primary_key}
        part = self._partition_of(own)
        if part is not None and all(v is not None for v in own.values()):
            number = xxhash64((own[c], kinds[c]) for c in self.spec.bucket_by) % self.spec.buckets
            return f"{part}/{number}"
        row = self.spark.range(1).select(*(F.lit(key[c]).cast(kinds[c]).alias(c) for c in self.spec.primary_key))
        return row.select(self._cell()).first()[0]

    def _partition_of(self, key: Mapping) -> str | None:
        """Partition of a key as its folder is named; None where only Spark's casts know."""
        values = [key.get(c) for c in self.spec.partition_by]
        if any(v is None or isinstance(v, datetime) or isinstance(v, str) and not v.isprintable() for v in values):
            return None
        return json.dumps([str(v) for v in values], ensure_ascii=False, separators=(",", ":"))

    def cells_below(self, key: Mapping) -> list[str] | None:
        """Cells of the base that rows with these leading key values can be in:
        those of one partition if the values fix it, else None (all)."""
        if not self.spec.partition_by or not set(self.spec.partition_by) <= set(key):
            return None
        kinds = {f.name: f.dataType for f in self.spec.schema.fields}
        part = self._partition_of({c: cast(key[c], kinds[c]) for c in self.spec.partition_by})
        if part is None:
            row = self.spark.range(1).select(*(F.lit(key[c]).cast(kinds[c]).alias(c) for c in self.spec.partition_by))
            part = row.select(self._partition()).first()[0]
        return [c for c in self.m.base if c.rpartition("/")[0] == part]

    def cells_of(self, keys: DataFrame) -> list[str]:
        """Cells of the base that the keys of ``keys`` (all key columns) can be in:
        a row a cell reaches the driver, of cells that there are."""
        if len(self.m.base) < 2:
            return list(self.m.base)
        kinds = {f.name: f.dataType for f in self.spec.schema.fields}
        own = keys.select(*(F.col(c).cast(kinds[c]).alias(c) for c in self.spec.primary_key)).select(self._cell().alias("cell")).distinct()
        there = self.spark.createDataFrame([(c,) for c in self.m.base], "cell string")
        return [r[0] for r in own.join(there, "cell", "left_semi").collect()]

    def _partition(self) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.spec.partition_by]
        return F.to_json(F.array(*parts)) if parts else F.lit("[]")

    def _cell(self) -> Column:
        return F.concat_ws("/", self._partition(), self.spec.bucket().cast("string"))

    def touch(self, cells: Iterable[str]) -> None:
        """Count reads of base cells; those read often are kept in memory, up to
        a number of bytes, least used first to go. Results do not change."""
        sizes = None
        for c in cells:
            if c not in self.m.base:
                continue
            self.reads[c] = self.reads.get(c, 0) + 1
            if c in self.kept:
                self.kept[c] = self.kept.pop(c)
            elif self.reads[c] >= self.options.hot_threshold:
                sizes = self.m.base_sizes.get(c, 0)
                if sizes > self.options.hot_bytes:
                    continue
                while self.kept and sum(b for _, b in self.kept.values()) + sizes > self.options.hot_bytes:
                    self.kept.pop(next(iter(self.kept)))[0].unpersist()
                self.kept[c] = (self.spark.read.schema(self.spec.schema).parquet(self.store.at("base", self.m.base[c])).persist(), sizes)

    def checked(self, build) -> list[Row]:
        """Rows of ``build()``; if files are missing the manifest is loaded again
        once, and then the answer is unavailable: never a miss."""
        for again in (True, False):
            try:
                return build().collect()
            except Exception as e:
                if not _missing_files(e):
                    raise
                if not again:
                    raise LookupUnavailable(str(e).splitlines()[0]) from e
                for df, _ in self.kept.values():
                    df.unpersist()
                self.kept.clear()
                self.metrics.add("repairs")
                self.refresh()
        raise AssertionError

    # -- life of runs ----------------------------------------------------

    def _write(self, df: DataFrame, name: str, state: str, flush_from: int, flush_to: int, **options: str) -> Run:
        """Write changes as a run; its statistics are observed on the way."""
        seen = Observation()
        low, high = F.min(F.struct(*self.spec.primary_key)), F.max(F.struct(*self.spec.primary_key))
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"), F.min("_seq").alias("a"), F.max("_seq").alias("b"), F.to_json(low).alias("x"), F.to_json(high).alias("y"))
        watched.write.options(**options).parquet(self.store.at("hot", name))
        got = seen.get
        ends = [list(json.loads(got[c]).values()) if got.get(c) else [] for c in ("x", "y")]
        return Run(name, state, flush_from, flush_to, got["a"] or 0, got["b"] or 0, got["n"], sum(self.store.files("hot", name).values()), mf.now(), *ends)

    def freeze(self) -> int:
        """Close the open batches; returns the fence, the last sequence in them. Nothing open: the last fence."""
        waiting = self.m.of(OPEN)
        if waiting:
            for r in waiting:
                r.state, r.flush_from, r.flush_to = FROZEN, self.m.flushes, self.m.flushes
            self.m.flushes += 1
            self.m.frozen_seq = max(r.max_seq for r in waiting)
            self._publish()
        return self.m.frozen_seq

    def _merged(self, runs: list[Run], state: str) -> Run:
        name = f"r-{uuid.uuid4().hex}"
        one = latest(self._runs(runs), self.spec.primary_key)
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.spec.primary_key}
        run = self._write(one.sortWithinPartitions(*self.spec.primary_key), name, state, runs[0].flush_from, runs[-1].flush_to, **blooms)
        run.written = min(r.written for r in runs)
        run.min_seq, run.max_seq = min(r.min_seq for r in runs), max(r.max_seq for r in runs)
        return run

    def flush(self) -> bool:
        """The oldest frozen group becomes a NEW run: sorted, one change a key.
        The run is published before its batches go."""
        frozen = self.m.of(FROZEN)
        if not frozen:
            return False
        group = [r for r in frozen if r.flush_from == frozen[0].flush_from]
        run = self._merged(group, NEW)
        ids = {r.id for r in group}
        at = self.m.runs.index(group[0])
        self.m.runs = [r for r in self.m.runs if r.id not in ids]
        self.m.runs.insert(at, run)
        self.m.flushed_seq = run.max_seq
        self._publish()
        return True

    def compact(self, ids: Iterable[str] | None = None, state: str = NEW) -> bool:
        """Adjacent runs of one state become one; deletes stay. A selection that is not there any more: nothing."""
        runs = compact_selection(self.m, state, self.options.compact_bytes) if ids is None else [r for r in self.m.runs if r.id in set(ids)]
        if len(runs) < 2 or ids is not None and len(runs) != len(set(ids)):
            return False
        if len({r.state for r in runs}) > 1 or runs[0].state not in (NEW, SINKED) or any(b.flush_from != a.flush_to + 1 for a, b in zip(runs, runs[1:], strict=False)):
            raise BadRequest("only adjacent runs of one state can be compacted")
        if self.m.prepared and {r.id for r in runs} & set(self.m.prepared["runs"]):
            raise BadRequest("a run of a sink under way cannot be compacted")
        run = self._merged(runs, runs[0].state)
        at = self.m.runs.index(runs[0])
        gone = {r.id for r in runs}
        self.m.runs = [r for r in self.m.runs if r.id not in gone]
        self.m.runs.insert(at, run)
        self._publish()
        return True

    def prepare_sink(self, target: int | None = None) -> dict | None:
        """First phase: the oldest NEW runs are merged into the cells that they
        touch, in a folder aside. Nothing to sink: None."""
        if self.m.prepared:
            return self.m.prepared
        runs = sink_selection(self.m, self.m.flushed_seq if target is None else target, self.options.sink_bytes)
        if not runs:
            return None
        commit = self.m.commits + 1
        name = f"c{commit:08d}-{uuid.uuid4().hex[:8]}"
        # merged once, and written, as both the cells and what is in them come of it
        work = self.store.at("work", name)
        latest(self._runs(runs), self.spec.primary_key).withColumn("_cell", self._cell()).write.parquet(work)
        changed = self.spark.read.schema(T.StructType([*self.spec.stored().fields, T.StructField("_cell", T.StringType())])).parquet(work)
        cells = [r[0] for r in changed.select("_cell").distinct().collect()]  # no more than there are partitions times buckets
        ids = {c: i for i, c in enumerate(sorted(cells))}
        # a large cell is written by several tasks
        slices = {c: 1 + self.m.base_sizes.get(c, 0) // self.options.cell_task_bytes for c in cells}
        numbers = self.spark.createDataFrame([(c, i, slices[c]) for c, i in ids.items()], "_cell string, _c int, _slices long")
        before = self.base([c for c in cells if c in self.m.base]).withColumn("_cell", self._cell())
        small = sum(r.bytes for r in runs) <= self.options.key_broadcast_bytes
        after = overlay(before, changed, self.spec.primary_key, small)
        after = after.join(F.broadcast(numbers) if len(cells) <= 100_000 else numbers, "_cell").withColumn("_slice", F.pmod(F.xxhash64(*self.spec.primary_key), "_slices"))
        dealt = after.repartition("_c", "_slice").sortWithinPartitions("_c", *self.spec.primary_key).select(*self.spec.columns, "_c")
        dealt.write.partitionBy("_c").parquet(self.store.at("base", name))
        self.store.delete("work", name)
        files = self.store.files("base", name)
        full = {int(f.partition("_c=")[2].partition("/")[0]) for f in files}
        self.m.prepared = {
            "commit": commit, "runs": [r.id for r in runs], "max_seq": max(r.max_seq for r in runs), "folder": name, "files": files,
            "cells": {c: f"{name}/_c={i}" if i in full else None for c, i in ids.items()},
        }
        self._publish()
        return self.m.prepared

    def commit_sink(self) -> bool:
        """Second phase: the files are there with their sizes, then one manifest
        makes them the base, its runs SINKED, and their sequence persisted. Repeating it changes nothing."""
        p = self.m.prepared
        if p is None:
            return False
        if self.store.files("base", p["folder"]) != p["files"]:
            raise LookupUnavailable(f"files of commit {p['commit']} are missing or cut off")
        sizes: dict[str, int] = {}
        for f, n in p["files"].items():
            folder = f"{p['folder']}/{f.partition('/')[0]}"
            sizes[folder] = sizes.get(folder, 0) + n
        for cell, folder in p["cells"].items():
            if cell in self.kept:
                self.kept.pop(cell)[0].unpersist()
            self.reads.pop(cell, None)
            if folder is None:
                self.m.base.pop(cell, None)
                self.m.base_sizes.pop(cell, None)
            else:
                self.m.base[cell], self.m.base_sizes[cell] = folder, sizes[folder]
        for r in self.m.runs:
            if r.id in p["runs"]:
                r.state = SINKED
        self.m.persisted_seq = max(self.m.persisted_seq, p["max_seq"])
        self.m.commits, self.m.prepared = p["commit"], None
        self._publish()
        return True

    def resume_sink(self) -> bool:
        """Finish a sink that was prepared; nothing is merged again."""
        return self.commit_sink()

    def sink(self, target: int | None = None) -> bool:
        return self.prepare_sink(target) is not None and self.commit_sink()

    def evict(self) -> bool:
        """The oldest SINKED run leaves the hot tier; its files go at the next vacuum."""
        runs = self.m.of(SINKED)
        if not runs or self.m.runs[0].id != runs[0].id:
            return False
        self.m.runs.remove(runs[0])
        self._publish()
        return True

    def vacuum(self) -> int:
        """Delete files that the manifest does not name; readers of older versions must have ended."""
        hot = {r.id for r in self.m.runs}
        gone = [("hot", n) for n in self.store.names("hot") if n not in hot]
        gone += [("work", n) for n in self.store.names("work")]
        used = set(self.m.base.values())
        staged = (self.m.prepared or {}).get("folder")
        for folder in self.store.names("base"):
            own = [f"{folder}/{n}" for n in self.store.names("base", folder) if n.startswith("_c=")]
            if folder != staged and not any(o in used for o in own):
                gone.append(("base", folder))
            elif folder != staged:
                gone += [("base", o) for o in own if o not in used]
        for g in gone:
            self.store.delete(*g)
        return len(gone)

    # -- maintenance -----------------------------------------------------

    def request_flush(self) -> int:
        """Fence up to which maintenance shall flush; done when ``flushed_seq`` is there."""
        self.fences.flush = self.m.next_seq - 1
        return self.fences.flush

    def request_sink(self) -> int:
        self.fences.sink = self.m.next_seq - 1
        return self.fences.sink

    def step(self, now: float | None = None) -> Action:
        a = decide(self.m, self.options, self.fences, mf.now() if now is None else now)
        {
            "none": lambda: None, "resume": self.resume_sink, "freeze": self.freeze, "flush": self.flush, "sink": self.sink,
            "compact": lambda: self.compact(a.runs), "evict": self.evict,
        }[a.kind]()
        if not self.m.of(OPEN, FROZEN, NEW):
            self.fences.recovered = False
        return a

    def maintain(self, now: float | None = None) -> list[Action]:
        """Steps until nothing is to do, up to the actions of a pass."""
        out = []
        for _ in range(self.options.actions_per_pass):
            a = self.step(now)
            if a.kind == "none":
                break
            out.append(a)
        return out

    def flush_all(self) -> int:
        """Freeze and flush everything written; returns the fence."""
        fence = self.freeze()
        while self.flush():
            pass
        return fence

    def sink_all(self) -> int:
        fence = self.flush_all()
        while self.sink():
            pass
        return fence

    def state(self) -> dict:
        """Counts, bytes, sequence bounds and ages."""
        m, now = self.m, mf.now()
        out: dict = {
            "version": m.version, "writer_id": m.writer_id, "next_seq": m.next_seq, "frozen_seq": m.frozen_seq, "flushed_seq": m.flushed_seq,
            "persisted_seq": m.persisted_seq, "commits": m.commits, "base_cells": len(m.base), "sink_prepared": m.prepared is not None,
            "kept_cells": len(self.kept), "kept_bytes": sum(b for _, b in self.kept.values()), "closed": self.closed, "flush_fence": self.fences.flush, "sink_fence": self.fences.sink,
            "base_bytes": m.base_bytes, "metrics": self.metrics.snapshot(),
        }
        for s in (OPEN, FROZEN, NEW, SINKED):
            runs = m.of(s)
            out |= {
                f"{s.lower()}_runs": len(runs), f"{s.lower()}_rows": sum(r.rows for r in runs), f"{s.lower()}_bytes": sum(r.bytes for r in runs),
                f"{s.lower()}_min_seq": min((r.min_seq for r in runs), default=None), f"{s.lower()}_max_seq": max((r.max_seq for r in runs), default=None),
                f"{s.lower()}_age": now - min((r.written for r in runs), default=now),
            }
        return out

    def runs(self) -> DataFrame:
        """A row a run, from the manifest."""
        rows = [(r.id, r.state, r.flush_from, r.flush_to, r.min_seq, r.max_seq, r.rows, r.bytes) for r in self.m.runs]
        return self.spark.createDataFrame(rows, "run_id string, state string, flush_from int, flush_to int, min_seq long, max_seq long, entry_count long, bytes long")

    def describe(self) -> dict:
        return self.spec.to_json() | {"fingerprint": self.spec.fingerprint(), "max_batch_rows": self.options.max_batch_rows, "max_prefix_results": self.options.max_prefix_results}


def _missing_files(e: Exception) -> bool:
    """Is it that files are not there? By the error's class, or by its causes in the JVM."""
    if isinstance(e, PySparkException) and (e.getCondition() or "").partition(".")[0] in ("PATH_NOT_FOUND", "FAILED_READ_FILE"):
        return True
    cause = getattr(e, "java_exception", None)
    if cause is None:
        return "FileNotFoundException" in str(e)
    while cause is not None:
        if cause.getClass().getName() in ("java.io.FileNotFoundException", "java.nio.file.NoSuchFileException"):
            return True
        cause = cause.getCause()
    return False


__all__ = ["Table", "live"]
