"""Numbered manifests: the only thing that a store commits.

A state is a small JSON object that names the folders which count. Its file is created exclusively under the next
number, so of two writers one fails, and what a broken run wrote is named by no manifest and never read.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifests:
    """The manifests in a folder; ``empty`` is the state before the first one (its ``version`` is 0)."""

    def __init__(self, spark: SparkSession, folder: str, empty: dict):
        self.spark, self.folder, self.empty = spark, folder.rstrip("/"), empty

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _file(self, version: int) -> str:
        return f"{self.folder}/{version:08d}.json"

    def versions(self) -> list[int]:
        fs, folder = self._fs(self.folder)
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder))

    def load(self, version: int) -> dict | None:
        """A manifest, or None where its writer was lost before it was whole."""
        fs, path = self._fs(self._file(version))
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> dict:
        for version in reversed(self.versions()):
            if (found := self.load(version)) is not None:
                return found
        return json.loads(json.dumps(self.empty))

    def next_version(self) -> int:
        return (self.versions() or [0])[-1] + 1

    def commit(self, state: dict) -> None:
        fs, path = self._fs(self._file(state["version"]))
        out = fs.create(path, False)  # fails where another run was first
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def drop(self, path: str) -> None:
        """Delete a folder that this store wrote and no manifest in use names."""
        fs, p = self._fs(path)
        fs.delete(p, True)

    def forget(self, before: int) -> None:
        """Delete the manifests below a version."""
        for version in self.versions():
            if version < before:
                self.drop(self._file(version))
