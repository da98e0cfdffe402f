"""An append-only log of events with snapshots: commit, replay, reachability and garbage.

A commit is a Parquet folder that a numbered version names.  State is a snapshot with the events after it laid over it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .heads import Heads, StaleHead


class EventLog:
    """Commits under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.heads = Heads(spark, f"{self.root}/heads")

    def head(self) -> int:
        """The number of the last commit; 0 before the first."""
        return self.heads.head()

    def commit(self, events: DataFrame, head: int) -> int:
        """Appends ``events`` after ``head``; StaleHead if another commit came first.  Data is written before it is named,
        so a writer that dies leaves only an unnamed folder."""
        name = uuid.uuid4().hex
        events.write.parquet(f"{self.root}/data/commit={name}")
        try:
            return self.heads.put(head, {"commit": head + 1, "after": head, "data": name})
        except StaleHead:
            self.heads.delete(f"{self.root}/data/commit={name}")
            raise

    def history(self) -> list[dict]:
        """All commits, oldest first; each must follow the one before it."""
        found = [self.heads.read(n) for n in self.heads.numbers()]
        for i, e in enumerate(found):
            if (e["commit"], e["after"]) != (i + 1, i):
                raise ValueError(f"commit {e['commit']} does not follow {i}")
        return found

    def events(self, after: int = 0) -> DataFrame | None:
        """Events of the commits after a number, with ``commit_no``: one read of all their folders."""
        wanted = [e for e in self.history() if e["commit"] > after]
        if not wanted:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", "true").parquet(*(f"{self.root}/data/commit={e['data']}" for e in wanted))
        numbers = self.spark.createDataFrame([(e["data"], e["commit"]) for e in wanted], "commit string, commit_no long")
        return rows.join(F.broadcast(numbers), "commit").drop("commit")

    def garbage(self) -> list[str]:
        """Data folders that no commit names."""
        named = {f"commit={e['data']}" for e in self.history()}
        return [f"{self.root}/data/{n}" for n in self.heads.names(f"{self.root}/data") if n not in named]


def state_at(events: DataFrame, keys: list[str], order: str, until: int | None = None) -> DataFrame:
    """The latest event of each key, up to ``until``; keys whose latest event is ``gone`` have no row."""
    rows = events if until is None else events.where(F.col(order) <= until)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", rank).where((F.col("_n") == 1) & ~F.col("gone")).drop("_n")


def replay(snapshot: DataFrame, later: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A snapshot with later events laid over it; equals the state from all events."""
    last = later.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return snapshot.join(last.select(*keys), keys, "left_anti").unionByName(last.where(~F.col("gone")).select(snapshot.columns))


def reachable(roots: DataFrame, edges: DataFrame, depth: int = 10_000) -> DataFrame:
    """(node) that can be reached from roots (node) by edges (source, target), a generation at a time."""
    seen = roots.select("node").distinct()
    frontier = seen
    for _ in range(depth):
        step = frontier.join(edges.select(F.col("source").alias("node"), "target"), "node").select(F.col("target").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def reachable_up(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``reachable`` where each source has one target at most, as in a forest: edges double their length each round, so a
    chain takes as many rounds as its length has bits.  Before round k all
    nodes within 2^k - 1 edges are known; a round that adds none has tried those 2^k edges away, so it ends, on cycles too."""
    seen = cut(roots.select("node").distinct())
    jump = cut(edges.select(F.col("source").alias("node"), "target").distinct())
    while True:
        step = seen.join(jump, "node").select(F.col("target").alias("node")).distinct()
        new = cut(step.join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))
        jump = cut(jump.join(jump.select(F.col("node").alias("target"), F.col("target").alias("_far")), "target").select("node", F.col("_far").alias("target")))


def unreachable(objects: DataFrame, roots: DataFrame, edges: DataFrame, before: object = None, forest: bool = False) -> DataFrame:
    """Objects (node, uploaded, ...) that nothing reaches and that are older than ``before``; ``forest`` says that each
    source has one target at most."""
    old = objects if before is None else objects.where(F.col("uploaded") < F.lit(before))
    return old.join((reachable_up if forest else reachable)(roots, edges), "node", "left_anti")
