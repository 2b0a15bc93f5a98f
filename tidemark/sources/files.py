"""Files of the store through Hadoop's file systems, and versioned manifests with exclusive commits.

A commit creates the manifest of the next number, and of two writers only one may succeed. That is so where a rename never replaces a
file (RENAME), where a file is created on a condition (CREATE), and on a local file system, by a hard link. Other stores check and then
write, which a second writer can slip between; they are refused.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Schemes of file systems by what they do in one step.
RENAME = frozenset(("hdfs", "webhdfs", "swebhdfs", "abfs", "abfss", "ofs", "o3fs"))
CREATE = frozenset(("gs",))


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Files:
    """The few file operations that a driver needs, on any store that Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, at, text: str) -> None:
        stream = self.fs.create(at, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Writes a file whole under its name, or raises Conflict if it exists; of several writers one succeeds."""
        at = self.fs.makeQualified(self._path(path))
        scheme = at.toUri().getScheme()
        part = self._path(f"{path}.{uuid.uuid4().hex}.part")
        if scheme in CREATE:
            try:
                return self._write(at, text)
            except Py4JJavaError as e:
                if "AlreadyExists" in e.java_exception.getClass().getName():
                    raise Conflict(path) from None
                raise
        if scheme not in RENAME and scheme != "file":
            raise ValueError(f"commits aren't exclusive on {scheme}://; use one of {sorted(RENAME | CREATE | {'file'})}")
        self._write(part, text)
        try:
            if scheme == "file":
                paths = self.jvm.java.nio.file.Paths
                self.jvm.java.nio.file.Files.createLink(paths.get(at.toUri()), paths.get(self.fs.makeQualified(part).toUri()))
            elif not self.fs.rename(part, at):
                raise Conflict(path)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(path) from None
            raise
        finally:
            self.fs.delete(part, False)

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength()

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class Manifest:
    """The metadata of one catalog: a state that each commit replaces whole, as a file of the next number.

    Data files are written first; they exist for readers once a manifest names them. One process may write to a catalog at a
    time; a second one that commits the same number gets Conflict and must start again.
    """

    KEEP = 20

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder
        self.number, self.state = 0, {}

    def _name(self, n: int) -> str:
        return f"{self.folder}/{n:012d}.json"

    def load(self) -> dict:
        numbers = [int(n[:12]) for n in self.files.names(self.folder) if n.endswith(".json") and n[:12].isdigit()]
        if numbers and max(numbers) != self.number:
            self.number = max(numbers)
            self.state = json.loads(self.files.read(self._name(self.number)))
        return self.state

    def commit(self, state: dict) -> None:
        self.files.create(self._name(self.number + 1), json.dumps(state))
        self.number, self.state = self.number + 1, state
        if self.number > self.KEEP:
            self.files.delete(self._name(self.number - self.KEEP))
