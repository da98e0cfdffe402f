"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut  # noqa: F401

#: The word of every contract: a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: A table that is joined by broadcast may have at most so many rows; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast if it is counted and found small; else left to a shuffle join, which
    adaptive execution splits where a key is skewed.  ``df`` should be checkpointed: it is counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(text: Column) -> Column:
    """How many words the text has; 0 for null."""
    return F.coalesce(F.expr("0L") + F.regexp_count(text, F.lit(WORD)), F.lit(0).cast("long"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    """Returns memory that was freed but is still held by the allocators to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], often: int = 64) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow that gives back memory every so many batches and at its end: workers outlive their tasks, and what
    one keeps the next one lacks."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(run(batches), 1):
            yield batch
            if i % often == 0:
                _give_back()
        _give_back()

    return held
