"""Rejection of a language that the models were not fitted on."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.llm import language_id


def test_a_language_left_out_of_the_fit_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id")) & (F.col("lang") != "en")).select("lang", "text"))
    got = {r.lang == "en": (r.bad / r.n) for r in language_id.predict_frame(docs, models, ["lang"]).groupBy("lang").agg(F.count_if("rejected").alias("bad"), F.count(F.lit(1)).alias("n")).where("lang in ('en', 'fr')").collect()}
    assert got[True] >= 0.95 and got[False] == 0
