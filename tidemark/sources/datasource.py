"""``spark.read.format("tidemark")`` and ``df.write.format("tidemark")``.

Reading is planned on the driver from the manifest: a task reads some base cells and
the hot changes of the same cells, in Arrow batches. Equality filters on the whole
key choose one cell; those on the first key column leave out runs that cannot hold it
(``register`` turns on the pushdown of filters to Python sources). A task holds the
hot changes of its cells; for large reads prefer ``Table.current()``, which stays
inside the JVM and splits cells.

Writing stages a run a task, with the places of its rows for sequences, then publishes
them together with what each run's places are shifted by: sequences are contiguous and
follow the order of the tasks, and nothing is written twice. A key's changes must come
from one task to be in order. Writes are refused as ``Table.append`` refuses them.

Options: ``path`` (needed; any file system that Arrow reaches: a mounted one, s3://,
gs://, hdfs://), ``kind`` (name of the column of change kinds, for writes),
``endpoint`` is taken for ``path``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.config import Options
from tidemark.errors import BadRequest, Overloaded, WriterFenced
from tidemark.functions.changelog import DELETES, PUTS
from tidemark.functions.hashing import cast, xxhash64
from tidemark.plans import manifest as mf
from tidemark.shipping import ship
from tidemark.spec import TableSpec

TASKS = 64  #: of a read, at most: each goes through the hot runs once
BATCH_ROWS = 64 << 10  #: rows of a file that are read together


class Files:
    """A table's folder, from the driver or a Python worker."""

    def __init__(self, root: str):
        self.root = root
        where = root.removeprefix("file://")
        self.fs, self.base = (pafs.LocalFileSystem(), where) if where.startswith("/") else pafs.FileSystem.from_uri(root)

    def names(self, *parts: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector("/".join((self.base, *parts)), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def data(self, folder: str) -> list[str]:
        return [f"{folder}/{n}" for n in self.names(folder) if not n.startswith(("_", ".")) and n.endswith(".parquet")]

    def size(self, path: str) -> int:
        return self.fs.get_file_info(f"{self.base}/{path}").size

    def json(self, path: str) -> dict:
        with self.fs.open_input_stream(f"{self.base}/{path}") as f:
            return json.loads(f.read())

    def delete(self, path: str) -> None:
        self.fs.delete_file(f"{self.base}/{path}")

    def parquet(self, path: str) -> pq.ParquetFile:
        return pq.ParquetFile(self.fs.open_input_file(f"{self.base}/{path}"))

    def spec(self) -> TableSpec:
        return TableSpec.from_json(self.json("table.json"))

    def manifest(self) -> mf.Manifest:
        d = self.json(f"manifest/{[n for n in self.names('manifest') if n.endswith('.json')][-1]}")
        d["runs"] = [mf.Run(**r) for r in d["runs"]]
        return mf.Manifest(**d)


def _root(options) -> str:
    path = options.get("path") or options.get("endpoint")
    if not path:
        raise BadRequest("option path is needed")
    return path.rstrip("/")


@dataclass
class Cells(InputPartition):
    names: tuple[str, ...]  #: OTHERS: all that are not in the base
    folders: tuple[str, ...]
    runs: tuple[tuple[str, int], ...]  #: and what their sequences are shifted by


OTHERS = "*"


class TidemarkReader(DataSourceReader):
    def __init__(self, root: str, spec: TableSpec):
        self.root, self.spec, self.equal = root, spec, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.spec.primary_key and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            yield f  # Spark checks all of them again

    def partitions(self) -> Sequence[InputPartition]:
        m = Files(self.root).manifest()
        kinds = {f.name: f.dataType for f in self.spec.schema.fields}
        lead = self.spec.primary_key[0]
        runs = m.runs
        if lead in self.equal and isinstance(v := cast(self.equal[lead], kinds[lead]), (int, str)):
            runs = [r for r in runs if not r.min_key or r.min_key[0] <= v <= r.max_key[0]]
        ids = tuple((r.id, r.shift) for r in runs)
        names = [*sorted(m.base), *([OTHERS] if ids else [])]
        own = {c: cast(self.equal[c], kinds[c]) for c in self.equal}
        if set(own) == set(self.spec.primary_key) and all(isinstance(v, (int, str)) for v in own.values()):
            name = _cell(self.spec, own)
            names = [name] if name in m.base else [OTHERS] if ids else []
        tasks = min(TASKS, max(len(names), 1))
        deal = [names[i::tasks] for i in range(tasks)]
        return [Cells(tuple(d), tuple(m.base[n] for n in d if n != OTHERS), ids) for d in deal]

    def read(self, cells: Cells) -> Iterator[pa.RecordBatch]:
        files, schema = Files(self.root), to_arrow_schema(self.spec.schema)
        key = list(self.spec.primary_key)
        hot = self._hot(files, cells)
        keys = hot.select(key) if hot is not None and hot.num_rows else None
        for folder in cells.folders:
            for path in files.data(f"base/{folder}"):
                for batch in files.parquet(path).iter_batches(BATCH_ROWS, columns=self.spec.columns):
                    t = self._equal(pa.Table.from_batches([batch]).select(self.spec.columns).cast(schema))
                    if keys is not None and t.num_rows:
                        t = t.join(keys, key, join_type="left anti").select(self.spec.columns)
                    yield from t.cast(schema).to_batches()
        if hot is not None:
            live = hot.filter(pc.invert(hot.column("_deleted"))).select(self.spec.columns)
            yield from live.cast(schema).to_batches()

    def _equal(self, t: pa.Table) -> pa.Table:
        if not self.equal or not t.num_rows:
            return t
        return t.filter(reduce(pc.and_, (pc.fill_null(pc.equal(t.column(c), pa.scalar(v).cast(t.column(c).type)), False) for c, v in self.equal.items())))

    def _hot(self, files: Files, cells: Cells) -> pa.Table | None:
        """The latest hot change of each key of the cells."""
        stored = to_arrow_schema(self.spec.stored())
        key = list(self.spec.primary_key)
        base = files.manifest().base if OTHERS in cells.names else {}
        own = set(cells.names)
        parts = []
        for r, shift in cells.runs:
            for path in files.data(f"hot/{r}"):
                for batch in files.parquet(path).iter_batches(BATCH_ROWS):
                    t = self._equal(pa.Table.from_batches([batch]).select(stored.names).cast(stored))
                    names = [_cell(self.spec, dict(zip(key, v, strict=True))) for v in zip(*(t.column(c).to_pylist() for c in key), strict=True)]
                    t = t.set_column(t.schema.get_field_index("_seq"), stored.field("_seq"), pc.add(t.column("_seq"), shift))
                    parts.append(t.filter(pa.array([n in own or OTHERS in own and n not in base for n in names], pa.bool_())))
        if not parts:
            return None
        t = pa.concat_tables(parts)
        last = t.group_by(key).aggregate([("_seq", "max")]).column("_seq_max")
        return t.filter(pc.is_in(t.column("_seq"), value_set=last.combine_chunks()))


def _cell(spec: TableSpec, key: dict) -> str:
    """As ``Table.cell_of``, for values of the columns' own types."""
    kinds = {f.name: f.dataType for f in spec.schema.fields}
    part = json.dumps([str(key[c]) for c in spec.partition_by], ensure_ascii=False, separators=(",", ":"))
    return f"{part}/{xxhash64((key[c], kinds[c]) for c in spec.bucket_by) % spec.buckets}"


@dataclass
class Written(WriterCommitMessage):
    part: int
    run: str | None
    rows: int
    bytes: int
    low: object  #: bounds of the first key column
    high: object


class TidemarkWriter(DataSourceArrowWriter):
    """Appends one changelog batch."""

    def __init__(self, root: str, spec: TableSpec, schema: StructType, kind: str | None):
        self.root, self.spec, self.kind = root, spec, kind
        if [c for c in schema.fieldNames() if c != kind] != spec.columns:
            raise BadRequest(f"a write needs exactly the columns {spec.columns}")
        m, options = Files(root).manifest(), Options()
        if len({r.flush_from for r in m.of(mf.FROZEN)}) >= options.max_frozen or len(m.of(mf.NEW)) >= options.max_new_runs:
            raise Overloaded("too many runs wait for maintenance")
        self.version, self.writer_id = m.version, m.writer_id
        self.name = f"b-{uuid.uuid4().hex}"

    def _stored(self, batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        """Rows as they are stored, with their places from ``at`` on as sequences."""
        schema, key = to_arrow_schema(self.spec.stored()), self.spec.primary_key
        kinds = batch.column(batch.schema.get_field_index(self.kind)).to_pylist() if self.kind else ["+I"] * batch.num_rows
        if bad := [k for k in kinds if k not in (*PUTS, *DELETES)]:
            raise BadRequest(f"unknown change kind: {bad[0]}")
        gone = pa.array([k in DELETES for k in kinds], pa.bool_())
        cols = []
        for f in schema:
            if f.name in ("_seq", "_deleted"):
                cols.append(gone if f.name == "_deleted" else pa.array(range(at, at + batch.num_rows), pa.int64()))
                continue
            c = batch.column(batch.schema.get_field_index(f.name)).cast(f.type)
            if f.name in key and c.null_count:
                raise BadRequest("null in a primary key column")
            if not self.spec.schema[f.name].nullable and f.name not in key and pc.any(pc.and_(pc.is_null(c), pc.invert(gone))).as_py():
                raise BadRequest(f"null in column {f.name}")
            cols.append(c if f.name in key else pc.if_else(gone, pa.scalar(None, f.type), c))
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, context = Files(self.root), TaskContext.get()
        part = context.partitionId() if context else 0
        run, rows, out, low, high = f"{self.name}-{part:05d}-{uuid.uuid4().hex[:8]}", 0, None, None, None
        path = f"hot/{run}/part-0.parquet"
        for batch in batches:
            if not batch.num_rows:
                continue
            stored = self._stored(batch, rows)
            ends = pc.min_max(stored.column(stored.schema.get_field_index(self.spec.primary_key[0]))).as_py()
            low, high = ends["min"] if low is None else min(low, ends["min"]), ends["max"] if high is None else max(high, ends["max"])
            if out is None:
                files.fs.create_dir(f"{files.base}/hot/{run}", recursive=True)
                out = pq.ParquetWriter(files.fs.open_output_stream(f"{files.base}/{path}"), stored.schema)
            out.write_batch(stored)
            rows += batch.num_rows
        if out is None:
            return Written(part, None, 0, 0, None, None)
        out.close()
        return Written(part, run, rows, files.size(path), low, high)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = Files(self.root)
        m = files.manifest()
        if (m.version, m.writer_id) != (self.version, self.writer_id):
            self.abort(messages)
            raise WriterFenced("the table has changed since this write began: another writer has it")
        own = sorted((w for w in messages if isinstance(w, Written) and w.run), key=lambda w: w.part)
        for w in own:  # runs of attempts that were given up have no name in the manifest, and go at a vacuum
            ends = [[v] if isinstance(v, (int, str)) else [] for v in (w.low, w.high)]
            m.runs.append(mf.Run(w.run, mf.OPEN, m.flushes, m.flushes, m.next_seq, m.next_seq + w.rows - 1, w.rows, w.bytes, time.time(), *ends, shift=m.next_seq))
            m.next_seq += w.rows
        if own:
            m.version += 1
            _publish(files, m)

    def abort(self, messages) -> None:
        files = Files(self.root)
        for w in messages:
            if isinstance(w, Written) and w.run:
                files.fs.delete_dir(f"{files.base}/hot/{w.run}")


def _publish(files: Files, m: mf.Manifest) -> None:
    """The manifest under its name, if no other is there."""
    to = f"{files.base}/manifest/{m.version:012d}.json"
    aside = f"{to}.tmp-{uuid.uuid4().hex}"
    with files.fs.open_output_stream(aside) as f:
        f.write(json.dumps(asdict(m)).encode())
    if isinstance(files.fs, pafs.LocalFileSystem):
        import os

        try:
            os.link(aside, to)  # fails if another writer was here
        except FileExistsError as e:
            raise WriterFenced(f"{to} is there already: another writer has this table") from e
        finally:
            os.remove(aside)
        return
    if files.fs.get_file_info(to).type != pafs.FileType.NotFound:
        files.fs.delete_file(aside)
        raise WriterFenced(f"{to} is there already: another writer has this table")
    files.fs.move(aside, to)


class TidemarkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> StructType:
        return Files(_root(self.options)).spec().schema

    def reader(self, schema: StructType) -> DataSourceReader:
        root = _root(self.options)
        return TidemarkReader(root, Files(root).spec())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise BadRequest("a table takes changes: use mode append")
        root = _root(self.options)
        return TidemarkWriter(root, Files(root).spec(), schema, self.options.get("kind"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TidemarkSource)
