"""Small files of a store in any file system that Spark reads, and a manifest that is swapped as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since the manifest was read."""


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file that isn't there, whole or not at all; False if it is there by now."""
        hidden = self._path(f".{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(self._path(name).getParent())
        done = not self.exists(name) and self._fs.rename(hidden, self._path(name))
        if not done:
            self._fs.delete(hidden, False)
        return done

    def mkdirs(self) -> None:
        self._fs.mkdirs(self._path(""))

    def qualified(self, folder: str) -> str:
        """A folder as Spark names it in paths of files."""
        path = self._hadoop.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Manifest:
    """Numbered versions of one JSON value. The last one counts, so a commit of several tables is seen as a whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def version(self) -> int:
        """0: nothing was committed yet."""
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        return int(names[-1].split(".")[0]) if names else 0

    def load(self, version: int | None = None) -> tuple[int, dict]:
        version = self.version() if version is None else version
        return version, json.loads(self.files.read(f"manifest/{version:012d}.json")) if version else {}

    def commit(self, value: dict, after: int) -> int:
        """Puts value in place as the version that follows `after`, the one it was made from."""
        if self.version() != after or not self.files.put_new(f"manifest/{after + 1:012d}.json", json.dumps(value, sort_keys=True)):
            raise ConcurrentCommit(f"version {after} is no longer the last one")
        return after + 1

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the last versions."""
        for name in [n for n in self.files.names("manifest") if n.endswith(".json")][:-keep]:
            self.files.drop(f"manifest/{name}")
