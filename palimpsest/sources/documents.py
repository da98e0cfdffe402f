"""Documents as JSON: reading bodies, typed metadata, and limits of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document may have so many bytes, a request so many documents and bytes.
DOC_BYTES, BATCH_DOCS, BATCH_BYTES = 4 << 20, 1000, 16 << 20


def body_variant(body: Column) -> Column:
    return F.try_parse_json(body)


def metadata(doc: Column) -> Column:
    """path, type, size, mtime and soft_deleted of a VARIANT body; a field of another kind is null."""

    def field(name: str, kinds: str, to: str) -> Column:
        v = F.try_variant_get(doc, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(v).rlike(kinds), F.try_variant_get(doc, f"$.{name}", to))

    number = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"
    return F.struct(
        field("path", "^STRING$", "string").alias("path"),
        field("type", "^STRING$", "string").alias("type"),
        field("size", number, "double").alias("size"),
        field("mtime", number, "double").alias("mtime"),
        F.coalesce(field("deleted", "^BOOLEAN$", "boolean"), F.lit(False)).alias("soft_deleted"),
    )


def read_documents(spark, path: str) -> DataFrame:
    """(body, id, meta) from newline-delimited JSON; broken lines keep their text and have a null id."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("body"), body_variant(F.col("value")).alias("_v"))
    return rows.select("body", F.try_variant_get("_v", "$._id", "string").alias("id"), metadata(F.col("_v")).alias("meta"))


def check_limits(batch: DataFrame) -> None:
    """Raises if a batch (body) is too large in any way; checked before anything is written."""
    size = F.octet_length("body")
    got = batch.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("most"), F.sum(size).alias("all")).first()
    if got.n > BATCH_DOCS or (got.most or 0) > DOC_BYTES or (got["all"] or 0) > BATCH_BYTES:
        raise ValueError(f"the batch is too large: {got.n} documents, {got['all']} bytes, {got.most} in one document")
