"""Files of a table, by Hadoop's file system interface: any store that Spark reads."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from tidemark.errors import WriterFenced

CLAIM_SECONDS = 60


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self._path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._path(self.at(*parts)))

    def names(self, *parts: str) -> list[str]:
        where = self._path(self.at(*parts))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def files(self, *parts: str) -> dict[str, int]:
        """Size of each data file below a folder, by path relative to it."""
        where = self._path(self.at(*parts))
        out: dict[str, int] = {}
        if not self.fs.exists(where):
            return out
        base = self.fs.getFileStatus(where).getPath().toString()
        each = self.fs.listFiles(where, True)
        while each.hasNext():
            s = each.next()
            name = s.getPath().toString()[len(base) + 1 :]
            if not name.rpartition("/")[2].startswith(("_", ".")):
                out[name] = s.getLen()
        return out

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._path(self.at(*parts)), True)

    def read_json(self, *parts: str) -> dict:
        stream = self.fs.open(self._path(self.at(*parts)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, value: dict, *parts: str) -> None:
        """All or nothing, and never in the place of another file: the name is
        claimed by a file that only one can create, then the value is renamed into it."""
        to, claim = self._path(self.at(*parts)), self.at(*parts) + ".claim"
        aside = self._path(f"{self.at(*parts)}.tmp-{uuid.uuid4().hex}")
        if self.fs.exists(to) or not self._claimed(claim):
            raise WriterFenced(f"{to.toString()} is there already: another writer has this table")
        try:
            out = self.fs.create(aside, False)
            try:
                out.write(bytearray(json.dumps(value).encode()))
                out.hsync()
            finally:
                out.close()
            if self.fs.exists(to) or not self.fs.rename(aside, to):
                raise WriterFenced(f"{to.toString()} is there already: another writer has this table")
        finally:
            self.fs.delete(self._path(claim), False)

    def _claimed(self, claim: str) -> bool:
        """Create a file that is not there. A claim that its maker left CLAIM_SECONDS ago is void."""
        path = self._path(claim)
        for _ in range(2):
            try:
                if self.fs.getScheme() == "file":
                    where = self.jvm.java.nio.file.Paths.get(path.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0))
                    self.jvm.java.nio.file.Files.createDirectories(where.getParent(), self._none("java.nio.file.attribute.FileAttribute"))
                    self.jvm.java.nio.file.Files.createFile(where, self._none("java.nio.file.attribute.FileAttribute"))
                else:
                    self.fs.create(path, False).close()
                return True
            except Exception:
                if not self.fs.exists(path):
                    raise
                if time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 < CLAIM_SECONDS:
                    return False
                self.fs.delete(path, False)
        return False

    def _none(self, kind: str):
        cls = self.jvm
        for part in kind.split("."):
            cls = getattr(cls, part)
        return self.spark.sparkContext._gateway.new_array(cls, 0)
