"""Exact vector search over the chunks of notes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import vector_id
from ..functions.tokens import chunk_markdown

#: Vectors that a search returns at most, and how many more are looked at where some may be out of date.
TOP, SPARE = 20, 8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def plan_chunks(notes: DataFrame) -> DataFrame:
    """(id, path, chunk_index, heading, text, preview, hash) of notes (path, content): what is to be embedded."""
    rows = notes.select("path", F.sha2("content", 256).alias("hash"), F.posexplode(chunk_markdown("path", "content")).alias("chunk_index", "c"))
    preview = F.substring(F.trim(F.regexp_replace("c.text", r"^\[[^\n]*\]\n", "")), 1, 300)
    return rows.select(vector_id(F.col("path"), F.col("chunk_index").cast("string")).alias("id"), "path", "chunk_index", "c.heading", "c.text", preview.alias("preview"), "hash")


def embed(chunks: DataFrame, embedder: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int = 50) -> DataFrame:
    """Chunks with ``values`` by a function from texts to vectors, called with ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        out: list = []
        for a in range(0, len(text), batch):
            out += [list(map(float, v)) for v in embedder(text.iloc[a : a + batch].tolist())]
        return pd.Series(out)

    return chunks.withColumn("values", run("text"))


def upsert(index: DataFrame, chunks: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index with all vectors of the chunks' paths replaced, and those of ``gone`` (path) removed: a path's stale tail
    goes with it."""
    out = index.join(chunks.select("path").distinct(), "path", "left_anti").unionByName(chunks.select(index.columns))
    return out.join(gone.select("path"), "path", "left_anti") if gone is not None else out


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 10, key: str = "id", values: str = "values", fresh: DataFrame | None = None) -> DataFrame:
    """(key, score) by cosine, ties to the smaller key.  ``fresh`` (path, hash) drops vectors of files that have changed; a
    vector without a hash passes."""
    rows = vectors
    if fresh is not None:
        now = fresh.select("path", F.col("hash").alias("_now"))
        rows = rows.join(now, "path").where(F.col("hash").isNull() | (F.col("hash") == F.col("_now"))).drop("_now")
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(key, cosine(F.col(values), wanted).alias("score")).orderBy(F.desc("score"), key).limit(min(k, TOP))
