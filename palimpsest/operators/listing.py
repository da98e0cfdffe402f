"""Listings of files: by folder, by time, by prefix, by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_markdown, level_entry, natural_key, note_date


def file_filter() -> Column:
    """Rows of (deleted, path, type, soft_deleted) that are files of the current state."""
    return ~F.col("deleted") & F.col("path").isNotNull() & ~F.coalesce("type", F.lit("")).isin("leaf", "chunkpack") & ~F.coalesce("soft_deleted", F.lit(False))


def list_files(current: DataFrame) -> DataFrame:
    return current.where(file_filter()).orderBy("path")


def list_markdown(current: DataFrame) -> DataFrame:
    return current.where(file_filter() & is_markdown(F.col("path")) & ~F.col("path").startswith("i:")).orderBy(natural_key(F.col("path")))


def list_directory(files: DataFrame, directory: str = "") -> DataFrame:
    """(type, name, path) of one level: folders first, names in natural order."""
    rows = files.select(level_entry(F.col("path"), directory).alias("e")).where(F.col("e").isNotNull()).select("e.*").distinct()
    return rows.orderBy("type", natural_key(F.col("name")))


def recent(files: DataFrame, limit: int = 20) -> DataFrame:
    """(path, mtime, size, modified_at), latest first; a file without a time counts as the oldest."""
    ms = F.col("mtime").cast("bigint")
    at = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return files.select("path", "mtime", "size", at.alias("modified_at")).orderBy(F.coalesce("mtime", F.lit(0.0)).desc(), "path").limit(min(max(limit, 1), 100))


def prefix_listing(files: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    """(path, total): the first paths with the prefix, and how many there are."""
    hit = files.where(F.col("path").startswith(prefix)).select("path")
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy("path").limit(limit).join(F.broadcast(total))


def similar_paths(files: DataFrame, name: str, limit: int = 5) -> DataFrame:
    base = name.rstrip("/").rpartition("/")[2].removesuffix(".md").lower()
    return files.where(F.lower("path").contains(base)).orderBy("path").limit(limit)


def daily_notes(files: DataFrame, limit: int = 20) -> DataFrame:
    """(date, path), newest first."""
    return files.select(note_date(F.col("path")).alias("date"), "path").where(F.col("date").isNotNull()).orderBy(F.desc("date"), "path").limit(limit)


def index_status(state: DataFrame) -> DataFrame:
    """One row of counts over (path, hash, fts_hash, pending)."""
    waits = ~F.col("pending") & F.col("hash").isNotNull() & (F.col("fts_hash").isNull() | (F.col("fts_hash") != F.col("hash")))
    return state.agg(F.count(F.lit(1)).alias("total"), F.count_if("pending").alias("pending"), F.count_if(F.col("hash").isNotNull() & ~F.col("pending")).alias("indexed"), F.count_if(waits).alias("fts_pending"))


def authorized(registry: DataFrame, person: str) -> DataFrame:
    """Rows of (vault, owner, readers) that a person owns or may read."""
    return registry.where((F.col("owner") == person) | F.array_contains("readers", person))
