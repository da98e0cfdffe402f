"""The query of each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_quality import line_quality

    return line_quality(_table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrapper import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score

    return score(_table(spark, sf_dir, "documents"))


def op7_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats, read_back, turn_events

    fixed = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", fixed), (-1, 1, "assistant", fixed)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_chats(turn_events(turns)))
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("learnt", learnt).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    return pack(pieces(_table(spark, sf_dir, "documents")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_line_quality": op3_line_quality,
    "op4_main_text": op4_main_text,
    "op5_mix_sources": op5_mix_sources,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_format_chats": op7_format_chats,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filter": op10_url_filter,
}

SQL: dict[str, str] = {
    "op2_near_duplicates": sql.OP2,
    "op3_line_quality": sql.OP3,
    "op5_mix_sources": sql.OP5,
    "op7_format_chats": sql.OP7,
    "op10_url_filter": sql.OP10,
}
