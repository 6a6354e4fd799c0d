"""A small file that says which folders a table consists of, so that a write counts wholly or not at all."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published first."""


class Pointer:
    """States of a folder as JSON files, numbered from 1; the one with the highest number counts.

    A writer puts new data into new folders, then publishes a state that names them.  A state is written beside and
    renamed to its number, which fails if that is taken; so readers see the state before or the state after, and of
    two writers that start from one state the second is refused.  A state has to stay small: it names folders.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = self._path(f"{self.root}/_states")
        self._files = self._folder.getFileSystem(self._conf)

    def _path(self, text: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def version(self) -> int:
        """The highest number; 0 before anything is published."""
        if not self._files.exists(self._folder):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(self._folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def read(self) -> tuple[int, dict[str, Any]]:
        n = self.version()
        if not n:
            return 0, {}
        stream = self._files.open(self._path(f"{self.root}/_states/{n}.json"))
        try:
            return n, json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def publish(self, state: dict[str, Any], after: int) -> int:
        """Makes state the next one after number `after`; Conflict if that isn't the latest any more."""
        beside = self._path(f"{self.root}/_states/_{uuid.uuid4().hex}")
        out = self._files.create(beside, False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        try:
            if self.version() != after:
                raise Conflict(f"{self.root} has moved on from state {after}")
            context.rename(self._files.makeQualified(beside), self._files.makeQualified(self._path(f"{self.root}/_states/{after + 1}.json")), options)
        except Exception as e:
            self._files.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.root} has moved on from state {after}") from e
            raise
        return after + 1

    def names(self, folder: str) -> list[str]:
        """What stands in a folder below the root."""
        place = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(place)) if self._files.exists(place) else []

    def keep_only(self, folder: str, names: set[str]) -> int:
        """Deletes all but these from a folder below the root; returns how many went.  Readers of earlier states lose what they read."""
        gone = [n for n in self.names(folder) if n not in names]
        for n in gone:
            self._files.delete(self._path(f"{self.root}/{folder}/{n}"), True)
        return len(gone)
