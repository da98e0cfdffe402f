"""The corpus pipeline over ``documents``: language, quality, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, so the
driver can write each one's result as Parquet and hand it to the next.  Other columns that a table may have are left out.  A
document without a doc_id is told by its text, so copies of it are found and mixed like others; where a group has documents
with ids, one of those stays.  Empty tables pass through as empty ones.  Language identification cannot be written in SQL, so
there is no SQL for the whole; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_side
from palimpsest.llm.language_id import identify
from palimpsest.llm.line_quality import line_quality
from palimpsest.llm.mixing import mix
from palimpsest.llm.near_dup import near_duplicates
from palimpsest.llm.packing import pack, pieces

#: Similarity in percent of five-word shingles at which documents are near-duplicates.
SIMILAR = 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents that the table has, so that others cannot clash with what a stage adds."""
    return docs.select(*(c for c in COLUMNS if c in docs.columns))


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id``: the doc_id, or where it is null a number above all usual ones that follows from the text."""
    return docs.withColumn("_id", F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; a missing language label is filled in."""
    docs = _documents(docs)
    found = identify(docs, keep=docs.columns).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    docs = _documents(docs)
    judged = line_quality(docs, keep=docs.columns, cleaned=True).where("kept")
    return judged.withColumn("text", F.col("cleaned_text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id; of several rows that have that one
    and are of the group, the smallest by text."""
    docs = _named(_documents(docs)).withColumn("_h", F.xxhash64("text"))
    judged = cut(near_duplicates(docs, percent=SIMILAR, doc_id="_id", text_hash=True).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "kept"))
    gone = judged.where(~F.col("kept")).select("_id", "_h").distinct()
    left = docs.join(small_side(cut(gone)), ["_id", "_h"], "left_anti")
    # only ids that stay more than once are looked at for repeated rows, so other texts do not travel
    again = judged.where("kept").groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id")
    again = small_side(cut(again))
    columns = [c for c in docs.columns if c not in ("_id", "_h")]
    first = F.min(F.struct("text", *(c for c in columns if c != "text")))
    one = left.join(again, "_id", "left_semi").groupBy("_id").agg(first.alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in columns))
    return left.join(again, "_id", "left_anti").select(columns).unionByName(one)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded to whole copies; rows of one doc_id share what it takes."""
    docs = _named(_documents(docs))
    taken = mix(docs, doc_id="_id").groupBy(F.col("doc_id").alias("_id")).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    taken = taken.where("size > 0").select("_id", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_n")).where("_n > 0")
    return docs.join(taken, "_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n"))).drop("_id", "_n", "_copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens.  Copies of a piece are told apart by ``copy``, from 1."""
    packed = pack(pieces(docs))
    order = Window.partitionBy("doc_id", "piece", "ids_crc32").orderBy("sequence_id", "offset")
    return packed.withColumn("copy", F.row_number().over(order))


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)  # the next stage reads its input more than once
    return docs
