"""Contents of notes: ordered chunks to texts and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import chunk_id, content_pieces


def reassemble(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, content) of notes (id, children, eden) from chunks (id, data).

    ``children`` lists chunk ids in order, repeats allowed; a chunk that is not stored is taken from the note's own ``eden``
    map if it has one.  Content is all or nothing: null if any piece is missing or there is no list, empty for an empty one."""
    has_eden = "eden" in notes.columns
    own = F.try_element_at("eden", F.col("child")) if has_eden else F.lit(None).cast("string")
    listed = notes.select("id", *(["eden"] if has_eden else []), F.posexplode("children").alias("p", "child"))
    stored = chunks.select(F.col("id").alias("child"), "data")
    pieces = listed.join(stored, "child", "left").select("id", "p", F.coalesce("data", own).alias("data"))
    # count(*) = count(data): every piece is there
    whole = pieces.groupBy("id").agg(
        F.when(F.count(F.lit(1)) == F.count("data"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "data"))), lambda s: s["data"]), "")).alias("content")
    )
    empty = F.when(F.size("children") == 0, F.lit(""))
    return notes.select("id", empty.alias("_none")).join(whole, "id", "left").select("id", F.coalesce("content", "_none").alias("content"))


def reassemble_turns(pieces: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, pieces, content) of rows that are a note's ordered pieces; null content if a place between 0 and the last is
    missing or holds null."""
    grouped = pieces.groupBy(key).agg(
        F.count(F.lit(1)).alias("pieces"), F.max(order).alias("_last"), F.count(text).alias("_have"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("_all")
    )
    whole = (F.col("pieces") == F.col("_last") + 1) & (F.col("_have") == F.col("pieces"))
    return grouped.select(key, "pieces", F.when(whole, F.array_join(F.transform("_all", lambda s: s["t"]), "")).alias("content"))


def missing_children(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, missing): chunk ids that notes wait for."""
    listed = notes.select("id", F.explode("children").alias("child"))
    return listed.join(chunks.select(F.col("id").alias("child")), "child", "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("child")).alias("missing"))


def dependents(changed: DataFrame, notes: DataFrame) -> DataFrame:
    """(id) of notes that list a changed chunk (id)."""
    return notes.select("id", F.explode("children").alias("child")).join(changed.select(F.col("id").alias("child")), "child", "left_semi").select("id").distinct()


def chunk_note(notes: DataFrame) -> DataFrame:
    """(id, pos, child, data) of notes (id, content): content cut into chunks, equal pieces under one name."""
    pieces = notes.select("id", F.posexplode(content_pieces("content")).alias("pos", "data"))
    return pieces.select("id", "pos", chunk_id(F.col("data")).alias("child"), "data")


def store_chunks(pieces: DataFrame) -> DataFrame:
    """Distinct chunks (id, data) of chunk_note's rows: what is written once whatever refers to it."""
    return pieces.groupBy(F.col("child").alias("id")).agg(F.first("data").alias("data"))


def fixed_pieces(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, chunk_index, chunk) of texts cut every ``size`` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    rows = texts.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return rows.select(key, "chunk_index", F.col("_t").substr(F.col("chunk_index") * size + 1, F.lit(size)).alias("chunk"))


def append_block(content: DataFrame, block: str) -> DataFrame:
    """(id, content) with a block after the text, one empty line between."""
    base = F.regexp_replace("content", r"\s+$", "")
    return content.withColumn("content", F.when(base == "", F.lit(block + "\n")).otherwise(F.concat(base, F.lit("\n\n" + block + "\n"))))


def unchanged(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Candidates (path, hash) that the state already has with this hash."""
    return candidates.join(state.select("path", "hash"), ["path", "hash"], "left_semi")


def changed(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """The others: new or different ones, which is all that has to be worked on."""
    return candidates.join(state.select("path", "hash"), ["path", "hash"], "left_anti")
