"""The interface of a full-text index, and one that is kept in Parquet.

Writers publish a batch as a segment in one step; searches go on with the version that they began with.  A rebuild fills a
second generation beside the first and takes its place when it is complete.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fulltext
from .postings import LAYOUT, SegmentIndex


class FullTextIndex(ABC):
    """What a store needs of an index.  Notes are rows (path, hash, content)."""

    #: Names the analyzer and layout: another version means another index.
    version: str

    @abstractmethod
    def upsert(self, notes: DataFrame, batch: str) -> None:
        """Puts notes in place of what there is under their paths; notes with the hash that is there are skipped."""

    @abstractmethod
    def delete(self, paths: DataFrame, batch: str) -> None: ...

    @abstractmethod
    def search(self, query: str, limit: int = 10, accept: Column | None = None, validate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(path, score, match_count); ``accept`` tests paths, ``validate`` drops hits (path, hash) that are out of date.
        Neither changes the statistics that scores are made of."""

    @abstractmethod
    def begin_rebuild(self) -> FullTextIndex: ...

    @abstractmethod
    def complete_rebuild(self, built: FullTextIndex) -> None: ...


class ParquetIndex(FullTextIndex):
    """A stored index of notes' contents by the ASCII analyzer: a search reads the postings of its terms."""

    version = f"segments-{LAYOUT}"

    def __init__(self, spark: SparkSession, root: str, generation: str = "active"):
        self.spark, self.root = spark, root.rstrip("/")
        self.segments = SegmentIndex(spark, self.root, generation=generation)

    def upsert(self, notes: DataFrame, batch: str) -> None:
        self.segments.append(notes.select("path", "hash", "content"), batch)
        self.segments.merge()

    def delete(self, paths: DataFrame, batch: str) -> None:
        none = F.lit(None).cast("string")
        self.segments.append(paths.select("path", none.alias("hash"), none.alias("content")), batch)

    def search(self, query, limit=10, accept=None, validate=None):
        fresh = None
        if validate is not None:
            fresh = validate(self.segments.documents().select("path", "hash"))
        return self.segments.search(fulltext.word_phrases(query), limit, accept=accept, validate=fresh).select("path", "score", "match_count")

    def begin_rebuild(self) -> ParquetIndex:
        return ParquetIndex(self.spark, self.root, f"build-{uuid.uuid4().hex}")

    def complete_rebuild(self, built: FullTextIndex) -> None:
        assert isinstance(built, ParquetIndex)
        self.segments.adopt(built.segments, f"rebuilt-{built.segments.version()['number']}")
        self.segments.sweep()
