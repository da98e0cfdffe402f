"""How the driver's tables stand in for a document store.

``events`` is a forest of revisions, in closed form: of a user's events in order of time, number rn has generation
rn - rn div 4; its parent is the one two before where rn mod 4 is 0 or 1, else the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.postings import LAYOUT, SegmentIndex
from ..session import checkpoint_dir, fingerprint, table


def revs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of events.  Every tenth user's are all deleted, so that deleted winners occur."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(own))
    e = e.withColumn("gen", F.col("rn") - F.floor(F.col("rn") / 4))
    e = e.withColumn("rev", F.concat(F.col("gen").cast("string"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 8, "0")))
    parent = F.when(F.col("rn") == 1, F.lit(None)).when((F.col("rn") % 4).isin(0, 1), F.lag("rev", 2).over(own)).otherwise(F.lag("rev", 1).over(own))
    return e.select(
        F.col("user_id").cast("string").alias("id"),
        "rev",
        F.col("gen").cast("bigint").alias("gen"),
        parent.alias("parent_rev"),
        (F.col("event_id") + 1).alias("seq"),
        ((F.col("event_type") == "error") | (F.col("user_id") % 10 == 0)).alias("deleted"),
        F.col("props").alias("body"),
        F.lit(True).alias("body_available"),
        F.col("event_type").alias("type"),
        F.col("value").alias("size"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("mtime"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: lang/source/id.md, with labels as soft deletions."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", path.alias("path"), F.lit("plain").alias("type"), F.lit(False).alias("deleted"), (F.coalesce("toxic", F.lit(0)) == 1).alias("soft_deleted"), F.col("n_chars").cast("double").alias("size"), (F.col("doc_id") * 1000).cast("double").alias("mtime"), "text"
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes to be indexed: the whole text, and its first line as a title."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"), F.col("text").alias("body"), F.substring_index("text", "\n", 1).alias("title"))


def stored_index(spark: SparkSession, sf_dir: str) -> SegmentIndex:
    """The index of ``notes`` in the shared folder, made when it is first asked for and again when the table's files change."""
    name = fingerprint(table(spark, sf_dir, "documents"))
    index = SegmentIndex(spark, f"{checkpoint_dir(spark)}/index-{LAYOUT}-{name}", ("body", "title"), "bigint")
    if index.version()["number"] == 0:
        index.append(notes(spark, sf_dir), name)
    return index


def grown_index(spark: SparkSession, sf_dir: str) -> SegmentIndex:
    """An index of its own that grew by steps: old versions of every fourth note, all notes, then every tenth deleted."""
    index = SegmentIndex(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", ("body",), "bigint")
    new = notes(spark, sf_dir).select("path", "hash", "body")
    index.append(new.where("path % 4 = 0").select("path", F.lit("old").alias("hash"), F.concat("body", F.lit(" outdated")).alias("body")), "1")
    index.append(new, "2")
    index.append(new.where("path % 10 = 0").withColumn("hash", F.lit(None).cast("string")), "3")
    return index
