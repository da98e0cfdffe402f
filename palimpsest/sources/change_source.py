"""The change feed as a Spark data source: ``spark.read.format("changefeed")`` and ``spark.readStream``.

Rows come from Parquet files of (seq, id, rev, deleted) in a folder that driver and executors share, in spans of sequences,
each of them one task's.  The offset is the
sequence, so a stream that starts again goes on after what it has seen; ``startingSeq`` is a number or ``now``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "seq long, id string, rev string, deleted boolean"

#: Sequences that one task reads.
ROWS = 1_000_000


class _Range(InputPartition):
    def __init__(self, after: int, until: int):
        super().__init__((after, until))
        self.after, self.until = after, until


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    files, at = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (None, path)
    return ds.dataset(at, filesystem=files, format="parquet")


def _last(path: str) -> int:
    """The greatest sequence, from the column statistics of files that have them and from the column of the others."""
    import pyarrow.compute as pc

    best = 0
    for fragment in _dataset(path).get_fragments():
        for group in fragment.row_groups:
            known = (group.statistics or {}).get("seq")
            if known is not None:
                best = max(best, known["max"])
            elif group.num_rows:
                best = max(best, pc.max(fragment.subset(row_group_ids=[group.id]).to_table(columns=["seq"]).column(0)).as_py() or 0)
    return best


def _ranges(after: int, until: int, step: int) -> list[_Range]:
    """Spans of sequences, each read by a task of its own; files and row groups outside of a span are passed over."""
    return [_Range(a, min(a + step, until)) for a in range(after, until, step)] or [_Range(after, after)]


def _rows(path: str, after: int, until: int) -> Iterator:
    import pyarrow.dataset as ds

    test = (ds.field("seq") > after) & (ds.field("seq") <= until)
    yield from _dataset(path).to_table(filter=test, columns=["seq", "id", "rev", "deleted"]).sort_by("seq").to_batches()


class ChangeFeed(DataSource):
    """Options: ``path``, ``startingSeq`` (0, a number or ``now``), ``rowsPerTask``, and ``rowsPerBatch`` for streams."""

    @classmethod
    def name(cls) -> str:
        return "changefeed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _BatchReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        start = options.get("startingSeq", "0")
        self.last, self.step = _last(self.path), int(options.get("rowsPerTask", ROWS))
        self.start = self.last if start == "now" else int(start)

    def partitions(self):
        return _ranges(self.start, self.last, self.step)

    def read(self, partition):
        yield from _rows(self.path, partition.after, partition.until)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.start, self.step = options.get("startingSeq", "0"), int(options.get("rowsPerBatch", 1 << 40))
        self.rows = int(options.get("rowsPerTask", ROWS))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"seq": _last(self.path) if self.start == "now" else int(self.start)}

    def latestOffset(self) -> dict:
        last = _last(self.path)
        if self.at is None:
            self.at = self.initialOffset()["seq"]
        # sequences have no large gaps, so a span of them is a batch of rows
        self.at = min(last, self.at + self.step) if last > self.at else self.at
        return {"seq": self.at}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at or 0, end["seq"])
        return _ranges(start["seq"], end["seq"], self.rows)

    def read(self, partition):
        yield from _rows(self.path, partition.after, partition.until)

    def commit(self, end: dict) -> None:
        pass


def register(spark) -> None:
    spark.dataSource.register(ChangeFeed)
