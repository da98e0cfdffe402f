"""Positional full-text indexes, phrase search and BM25.

An index is three tables: documents (doc_id, length), postings (term, doc_id, positions) and nothing else; sort or bucket
postings by term, and a query reads only its own terms.  Statistics are exact.  Scores are sums over phrases, so they are an
aggregate, and a search is scan, join on doc_id, aggregate and top-k.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import FIELD_WEIGHTS, ascii_tokens, index_tokens, normal_length, phrases, query_phrases
from ..session import numbered

K1, B = 1.2, 0.75


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, position) by the ASCII analyzer, in the JVM; positions count words."""
    return docs.select(key, F.posexplode(ascii_tokens(F.col(text))).alias("position", "term"))


def exact_token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, position) by the analyzer with character bigrams; positions count normalised characters."""
    return docs.select(key, F.explode(index_tokens(text)).alias("t")).select(key, "t.term", "t.position")


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, normal_length(text).alias("length"))


def postings(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, positions, tf): a term's rows may be any number, a document's in one row are its own."""
    return tokens.groupBy("term", key).agg(F.sort_array(F.collect_list("position")).alias("positions"), F.count(F.lit(1)).alias("tf"))


def row_postings(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(term, *keys, positions, tf) by the ASCII analyzer where each row is a document of its own: words are sorted and
    grouped within the row, so nothing is shuffled and rows stay where they were dealt."""
    placed = F.transform(ascii_tokens(F.col(text)), lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    words = docs.select(*keys, F.sort_array(placed).alias("_words"))
    word = lambda i: F.get("_words", i)["term"]
    starts = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: (i == 0) | (word(i) != word(i - 1)))
    # no filter on the words themselves: it would be moved below the caller's shuffle and sort them there too
    runs = words.withColumn("_runs", F.when(F.size("_words") > 0, starts))
    end = lambda k: F.coalesce(F.get("_runs", k + 1), F.size("_words"))
    run = lambda i, k: F.struct(word(i).alias("term"), F.transform(F.slice("_words", i + 1, end(k) - i), lambda w: w["position"]).alias("positions"))
    rows = runs.select(*keys, F.explode_outer(F.transform("_runs", run)).alias("_p")).where(F.col("_p").isNotNull())
    return rows.select(F.col("_p.term").alias("term"), *keys, F.col("_p.positions").alias("positions"), F.size("_p.positions").cast("bigint").alias("tf"))


#: The words of ``ascii_tokens`` in a text that is lower-cased already.
_WORD = re.compile(r"[a-z0-9_]+")

#: Characters of texts whose words are in Python's memory at once, beyond a single longer text.
BATCH_CHARS = 2_000_000


@F.pandas_udf(T.IntegerType())
def n_words(text: pd.Series) -> pd.Series:
    """How many words a lower-cased text has by the ASCII analyzer."""
    return text.map(lambda t: len(_WORD.findall(t)) if t else 0)


def _grouped(rows: list[int], words: list[list[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Of texts as words, per term of each: the term, its text's row, the text's words, the term's positions."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array(list(itertools.chain.from_iterable(words)), pa.string()).dictionary_encode()
    owner = np.repeat(np.arange(len(words)), sizes)
    position = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # text, term and position in one number, so that plain sorting groups them; 64 bits hold those of any batch
    kinds, most = len(coded.dictionary), int(sizes.max())
    assert len(words) * kinds * most < 2**63
    packed = np.sort((owner * kinds + coded.indices.to_numpy()) * most + position)
    run = packed // most
    first = np.flatnonzero(np.diff(run, prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(run)), pa.int32()), pa.array(packed - run * most, pa.int32()))
    owner, term = np.divmod(run[first], kinds)
    return coded.dictionary.take(pa.array(term)), np.asarray(rows)[owner], sizes[owner], positions


def field_postings(docs: DataFrame, keys: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """(term, *keys, field, length, positions) by the ASCII analyzer, where each row is a document of its own; ``fields``
    names the text column of each field.  In Arrow batches, without a shuffle: columns of words are coded, sorted and
    grouped as numbers."""
    types = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField("term", T.StringType()), *(T.StructField(k, types[k]) for k in keys), T.StructField("field", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    names, kept = list(fields), list(keys)

    def table(batch: pa.RecordBatch, field: str, rows: list[int], words: list[list[str]]) -> pa.RecordBatch:
        term, row, length, positions = _grouped(rows, words)
        own = [batch.column(k).take(pa.array(row)) for k in kept]
        return pa.RecordBatch.from_arrays([term, *own, pa.array([field], pa.string()).take(pa.array(np.zeros(len(row), np.int64))), pa.array(length, pa.int32()), positions], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, field in enumerate(names):
                rows, words, chars = [], [], 0
                for i, text in enumerate(batch.column(len(kept) + n)):
                    found = _WORD.findall(text.as_py() or "")
                    if not found:
                        continue
                    size = sum(map(len, found))
                    if rows and chars + size > BATCH_CHARS:
                        yield table(batch, field, rows, words)
                        rows, words, chars = [], [], 0
                    rows.append(i)
                    words.append(found)
                    chars += size
                if rows:
                    yield table(batch, field, rows, words)

    return docs.select(*kept, *(F.lower(F.col(c)).alias(f"_t{n}") for n, c in enumerate(fields.values()))).mapInArrow(run, schema)


def term_df(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, cf): documents that have the term, and occurrences."""
    return tokens.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(tokens: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: documents, tokens, and tokens per document."""
    n = docs.agg(F.count(F.lit(1)).alias("doc_count"))
    return tokens.agg(F.count(F.lit(1)).alias("token_count")).join(n).select("doc_count", "token_count", (F.col("token_count") / F.col("doc_count")).alias("avg_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(n: Column, df: Column, tf: Column, length: Column, average: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def phrase_matches(tokens: DataFrame, wanted: Sequence[Sequence[tuple[str, int]]], key: str = "doc_id") -> DataFrame:
    """(phrase, key, base, tf): places where all of a phrase's terms stand at their distances.

    Each occurrence votes for the place where the phrase would begin; a place with a vote from each term is a match.  Only
    the phrases' own terms are read."""
    rows = [(i, t, p) for i, phrase in enumerate(wanted) for t, p in phrase]
    spark = tokens.sparkSession
    terms = spark.createDataFrame(rows or [(0, "", 0)], "phrase int, term string, offset int")
    sizes = spark.createDataFrame([(i, len(set(p))) for i, p in enumerate(wanted)] or [(0, 1)], "phrase int, size int")
    own = tokens.where(F.col("term").isin(sorted({t for _, t, _ in rows})))
    votes = own.join(F.broadcast(terms), "term").select("phrase", key, (F.col("position") - F.col("offset")).alias("base"), "term", "offset").distinct()
    bases = votes.groupBy("phrase", key, "base").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(sizes), "phrase").where("n = size")
    return bases.groupBy("phrase", key).agg(F.min("base").alias("base"), F.count(F.lit(1)).alias("tf"))


def search(tokens: DataFrame, docs: DataFrame, wanted: Sequence[Sequence[tuple[str, int]]], limit: int = 10, key: str = "doc_id", accept: DataFrame | None = None) -> DataFrame:
    """(key, score, match_count): documents with every phrase, best first.

    ``docs`` has (key, length).  ``accept`` (key) restricts hits, not statistics.  With no phrases there are no hits."""
    matches = phrase_matches(tokens, wanted, key)
    df = matches.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    stats = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("length"), F.lit(1.0)), F.lit(1.0)).alias("average"))
    scored = matches.join(F.broadcast(df), "phrase").join(docs.select(key, "length"), key).join(F.broadcast(stats))
    scored = scored.withColumn("s", bm25(F.col("n"), F.col("df"), F.col("tf"), F.col("length"), F.col("average")))
    hits = scored.groupBy(key).agg(F.sum("s").alias("score"), F.sum("tf").alias("match_count"), F.count(F.lit(1)).alias("_p")).where(F.col("_p") == len(wanted)).drop("_p")
    hits = hits.join(accept.select(key), key, "left_semi") if accept is not None else hits
    return hits.orderBy(F.desc("score"), key).limit(limit)


def search_text(tokens: DataFrame, docs: DataFrame, query: str, limit: int = 10, key: str = "doc_id", most_terms: int = 32) -> DataFrame:
    """A query in the language of the bigram analyzer: white space parts phrases."""
    wanted = phrases(query)
    if sum(map(len, wanted)) > most_terms:
        raise ValueError("the query has too many terms")
    return search(tokens, docs, wanted, limit, key)


def word_phrases(query: str, most_terms: int = 32, most_bytes: int = 4096) -> list[list[tuple[str, int]]]:
    """A query with quoted phrases, as terms and offsets in words."""
    wanted = query_phrases(query)
    if len({t for p in wanted for t in p}) > most_terms or len(query.encode()) > most_bytes:
        raise ValueError("the query is too long")
    return [[(t, i) for i, t in enumerate(p)] for p in wanted]


def search_fields(fields: DataFrame, wanted: Sequence[Sequence[tuple[str, int]]], limit: int = 10, key: str = "doc_id", weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score, match_count) over tokens (key, field, term, position), each field weighted and normalised by its own
    average length; a phrase lies within one field, and a document needs each phrase in any field."""
    weights = weights or FIELD_WEIGHTS
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    length = fields.groupBy(key, "field").agg(F.count(F.lit(1)).alias("length"))
    n = fields.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
    average = length.groupBy("field").agg(F.sum("length").alias("total")).join(F.broadcast(n)).select("field", "n", F.greatest(F.col("total") / F.col("n"), F.lit(1.0)).alias("average"))
    placed = fields.withColumn("place", F.struct(F.col(key), F.col("field")))
    matches = phrase_matches(placed, wanted, "place").select("phrase", F.col(f"place.{key}").alias(key), F.col("place.field").alias("field"), "tf")
    df = matches.select("phrase", key).distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    scored = matches.join(F.broadcast(df), "phrase").join(F.broadcast(average), "field").join(length, [key, "field"])
    scored = scored.withColumn("s", F.element_at(table, F.col("field")) * bm25(F.col("n"), F.col("df"), F.col("tf"), F.col("length"), F.col("average")))
    hits = scored.groupBy(key).agg(F.sum("s").alias("score"), F.sum("tf").alias("match_count"), F.count_distinct("phrase").alias("_p")).where(F.col("_p") == len(wanted)).drop("_p")
    return hits.orderBy(F.desc("score"), key).limit(limit)


# Segments: an index that grows by parts and is merged


def fresh(hits: DataFrame, state: DataFrame) -> DataFrame:
    """Hits (path, hash, ...) that still say what their file says: the hash is the file's, or neither has one."""
    now = state.select("path", F.col("hash").alias("_now"), F.col("fts_hash").alias("_fts"))
    live = F.when(F.col("hash").isNull(), F.col("_fts").isNull()).otherwise((F.col("hash") == F.col("_fts")) | (F.col("_fts").isNull() & (F.col("hash") == F.col("_now"))))
    return hits.join(now, "path").where(F.coalesce(live, F.lit(False))).drop("_now", "_fts")


def merge_segments(segment_docs: DataFrame, segment_postings: DataFrame, live: DataFrame, into: str = "merged") -> tuple[DataFrame, DataFrame]:
    """Documents and postings of all segments as one: stale and repeated (path, hash) go, the rest is numbered anew.

    segment_docs (segment, doc, path, hash, chars), segment_postings (segment, term, doc, positions), live (path, hash)."""
    kept = segment_docs.join(live.select("path", "hash"), ["path", "hash"], "left_semi")
    first = F.row_number().over(Window.partitionBy("path", "hash").orderBy("segment", "doc"))
    kept = kept.withColumn("_n", first).where("_n = 1").drop("_n")
    placed = numbered(kept, "new_doc", "segment", "doc").withColumn("new_doc", F.col("new_doc").cast("int"))
    docs = placed.select(F.lit(into).alias("segment"), F.col("new_doc").alias("doc"), "path", "hash", "chars")
    # a hash join: a merge join would sort all postings, and spill them
    moved = segment_postings.join(placed.select("segment", "doc", "new_doc").hint("shuffle_hash"), ["segment", "doc"]).select(F.lit(into).alias("segment"), "term", F.col("new_doc").alias("doc"), "positions")
    return docs, moved


def merge_plan(segments: DataFrame, most: int = 8, chars: int = 16_000_000) -> list[str]:
    """The two smallest of (segment, chars), if there are too many segments and both fit into one."""
    rows = segments.orderBy("chars", "segment").limit(2).collect()
    if segments.count() <= most or len(rows) < 2 or rows[0].chars + rows[1].chars > chars:
        return []
    return [r.segment for r in rows]


def rewrite_plan(segment_docs: DataFrame, live: DataFrame, share: float = 0.25, least: int = 250_000) -> DataFrame:
    """(segment, freed) that a rewrite would free most of, the first one worth it."""
    alive = live.select("path", "hash", F.lit(True).alias("_live"))
    by = segment_docs.join(alive, ["path", "hash"], "left").groupBy("segment").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("_live").isNull(), F.col("chars")).otherwise(0)).alias("freed"))
    return by.where((F.col("freed") >= least) & (F.col("freed") >= F.col("chars") * share)).orderBy(F.desc("freed"), "segment").limit(1).select("segment", "freed")


def overlay(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows with a delta over them: rows of the same keys are the delta's, and go where it is marked ``gone``."""
    return base.join(delta.select(*keys), list(keys), "left_anti").unionByName(delta.where(~F.col("gone")).drop("gone"))
