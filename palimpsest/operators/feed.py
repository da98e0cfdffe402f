"""The change feed and listings of documents by id."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.args import UNSET, feed_limit, key_value, row_limit, since_value
from ..session import cut
from . import revisions


def current_seq(current: DataFrame) -> int:
    return current.agg(F.coalesce(F.max("updated_seq"), F.lit(0)).alias("n")).first().n


def changes(revs: DataFrame, since: Any = 0, limit: Any = None, style: str = "main_only", match: Column | None = None, current: DataFrame | None = None) -> DataFrame:
    """A page of the feed: (seq, id, revs, deleted) by sequence.

    One row per document at its latest sequence.  ``main_only`` tests the winner with ``match`` and names it; ``all_docs``
    tests every leaf and names those that match.  ``deleted`` is the winner's in both.  ``match`` is a Column over revs."""
    current = current if current is not None else revisions.docs(revs)
    at = since_value(since, current_seq(current) if since == "now" else 0)
    page = current.where(F.col("updated_seq") > at)
    if style == "all_docs":
        tops = revisions.leaves(revs)
        tops = tops.where(match) if match is not None else tops
        named = tops.select("id", "rev").join(page, "id").groupBy("id", "updated_seq", "deleted").agg(F.sort_array(F.collect_list("rev")).alias("revs"))
    else:
        named = page.withColumn("revs", F.array("winning_rev"))
        if match is not None:
            # the tested columns are the winner's; the body is read for these rows only
            tested = revs.where(match).select("id", F.col("rev").alias("winning_rev"))
            named = named.join(tested, ["id", "winning_rev"], "left_semi")
    rows = named.select(F.col("updated_seq").alias("seq"), "id", "revs", "deleted")
    return rows.orderBy("seq").limit(feed_limit(limit, match is not None))


def page_end(page: DataFrame, current: DataFrame, limit: Any = None, narrow: bool = False) -> DataFrame:
    """(last_seq, pending) of a page: where the next one begins, and how many documents lie after that, filtered or not."""
    n = feed_limit(limit, narrow)
    ends = page.agg(F.count(F.lit(1)).alias("rows"), F.max("seq").alias("page_seq"))
    total = current.agg(F.coalesce(F.max("updated_seq"), F.lit(0)).alias("current"))
    at = ends.join(total).select(F.when(F.col("rows") >= n, F.col("page_seq")).otherwise(F.col("current")).alias("last_seq"))
    return current.join(F.broadcast(at), current.updated_seq > at.last_seq, "right").groupBy("last_seq").agg(F.count("id").alias("pending"))


def all_docs(current: DataFrame, start: Any = None, end: Any = None, inclusive_end: Any = True, descending: bool = False, skip: int = 0, limit: Any = None) -> DataFrame:
    """(id, rev) of live documents in order of id; ``start`` and ``end`` swap their sense with the direction."""
    rows = current.where(~F.col("deleted")).select("id", F.col("winning_rev").alias("rev"))
    low, high = key_value(start), key_value(end)
    if low is not UNSET:
        rows = rows.where(F.col("id") <= low if descending else F.col("id") >= low)
    if high is not UNSET:
        strict = inclusive_end in (False, "false")
        if descending:
            rows = rows.where(F.col("id") > high if strict else F.col("id") >= high)
        else:
            rows = rows.where(F.col("id") < high if strict else F.col("id") <= high)
    rows = rows.orderBy(F.desc("id") if descending else "id")
    rows = rows.offset(skip) if skip > 0 else rows
    n = row_limit(limit)
    return rows if n is None else rows.limit(n)


def all_docs_keys(current: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (pos, key) with (rev, deleted, error): rows in the order and number of the keys."""
    got = keys.join(current.select(F.col("id").alias("key"), F.col("winning_rev").alias("rev"), "deleted"), "key", "left")
    return got.select("pos", "key", "rev", F.when(F.col("deleted"), F.lit(True)).alias("deleted"), F.when(F.col("rev").isNull(), "not_found").alias("error")).orderBy("pos")


def find(winning: DataFrame, match: Column, limit: Any = None) -> DataFrame:
    """Live winners that match, by id: a page of 25 where no limit is given, of all but the last n for a limit of -n."""
    n = 25 if limit is None else int(limit)
    found = winning.where(~F.col("deleted") & match)
    if n >= 0:
        return found.orderBy("id").limit(n)
    found = cut(found)
    return found.orderBy("id").limit(max(found.count() + n, 0))


def matching(winning: DataFrame, match: Column) -> DataFrame:
    """All live winners that match, in no order: what find's pages are cut from."""
    return winning.where(~F.col("deleted") & match)


def info(current: DataFrame) -> DataFrame:
    """One row: live documents, deleted ones, and the sequence."""
    return current.agg(F.count_if(~F.col("deleted")).alias("doc_count"), F.count_if("deleted").alias("doc_del_count"), F.coalesce(F.max("updated_seq"), F.lit(0)).alias("update_seq"))


def feed_lines(page: DataFrame) -> DataFrame:
    """The page as newline-delimited JSON, one string column ``value``, for a text sink."""
    row = F.struct("seq", "id", F.transform("revs", lambda r: F.struct(r.alias("rev"))).alias("changes"), F.when(F.col("deleted"), F.lit(True)).alias("deleted"))
    return page.select(F.to_json(row).alias("value"))
