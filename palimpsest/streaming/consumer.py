"""Keeping derived tables up to date from a stream of changes.

``foreachBatch`` hands each micro-batch to a function that recomputes what its documents touch and lays it over the table.
Writes are idempotent: a version of the table tells the batch that made it, so a batch that runs twice ends the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.content import missing_children, reassemble
from ..operators.fulltext import overlay
from ..operators.heads import Heads

#: Deltas over a table before it is written anew.
DELTAS = 16


class VersionedTable:
    """A Parquet table in parts: rows are written once, and a numbered version names the parts that are the table.

    A version has a base and deltas over it, the oldest first; rows of a delta take the place of those before it with the
    same keys, or their place stays empty where they are marked ``gone``.  A batch writes its own rows only; when there are
    more than ``DELTAS`` deltas the next one writes the table anew.  Of two writers that follow one version one learns that
    its head is stale."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.heads = Heads(spark, f"{self.root}/versions")

    def version(self) -> dict:
        n = self.heads.head()
        return (self.heads.read(n) if n else {"batch": None, "base": None, "deltas": [], "keys": []}) | {"number": n}

    def current(self) -> str | None:
        """The batch that made the current version."""
        return self.version()["batch"]

    def read(self, version: dict | None = None) -> DataFrame | None:
        now = version or self.version()
        if now["base"] is None:
            return None
        out = self.spark.read.parquet(f"{self.root}/{now['base']}")
        for name in now["deltas"]:
            out = overlay(out, self.spark.read.parquet(f"{self.root}/{name}"), now["keys"])
        return out

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def publish(self, rows: DataFrame, batch: str) -> None:
        """``rows`` as the whole table."""
        now = self.version()
        self.heads.put(now["number"], {"batch": batch, "base": self._write(rows), "deltas": [], "keys": []})

    def lay_over(self, delta: DataFrame, keys: list[str], batch: str) -> None:
        """Rows (keys, ..., gone) over the table; a batch that made the current version is not taken again."""
        now = self.version()
        if now["batch"] == batch:
            return
        if now["base"] is None:
            entry = {"base": self._write(delta.where(~F.col("gone")).drop("gone")), "deltas": []}
        elif len(now["deltas"]) >= DELTAS:
            entry = {"base": self._write(overlay(self.read(now), delta, keys)), "deltas": []}
        else:
            entry = {"base": now["base"], "deltas": [*now["deltas"], self._write(delta)]}
        self.heads.put(now["number"], entry | {"batch": batch, "keys": keys})


def upsert_batch(table: VersionedTable, keys: list[str], derive: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: derived rows of the batch's documents take the place of the table's; rows that are
    marked ``gone`` leave it."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.lay_over(derive(batch), keys, f"v{number:012d}")

    return run


def follow(changes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream; ``once`` takes what there is and ends."""
    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def ready_notes(pending: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes (id, children) whose chunks have all arrived, with their content, and those that go on waiting.

    Late chunks may come at any time, so waiting notes are kept without a watermark and looked at again in each batch."""
    waits = missing_children(pending, chunks).select("id")
    ready = pending.join(waits, "id", "left_anti")
    return reassemble(ready, chunks), pending.join(waits, "id", "left_semi")
