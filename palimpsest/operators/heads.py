"""Numbered versions of anything, one writer at a time.

A version is a small JSON file named by its number, made by creating a file that must not exist yet: of two writers that
follow the same version one wins, and the other learns that its head is stale.  Every path goes through Spark's file
system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class StaleHead(Exception):
    """Another version has taken the number."""


class Heads:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().isdigit())

    def head(self) -> int:
        """The last number; 0 before the first."""
        return max([0, *self.numbers()])

    def read(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{n:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, after: int, entry: dict) -> int:
        """Makes the version that follows ``after``; StaleHead if there is one already."""
        n = after + 1
        if after != self.head():
            raise StaleHead(n)
        try:
            out = self._fs.create(self._path(f"{self.root}/{n:012d}"), False)
        except Exception as e:
            raise StaleHead(n) from e
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return n

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        """What is in a folder; nothing if there is none."""
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
