"""A mirror of the latest files: what is to be written, kept and removed, by fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import strict_base64
from ..functions.paths import is_safe

#: What makes a document something that a mirror cannot write.
ENCRYPTED_PREFIXES = ("e_", "h:++encrypted")


def unsupported(doc_id: Column, kind: Column, size: Column, most: int = 512 << 20) -> Column:
    """Why a file is not mirrored; null where it is."""
    secret = F.lit(False)
    for p in ENCRYPTED_PREFIXES:
        secret = secret | doc_id.startswith(p)
    return F.when(secret, "encrypted").when(~F.coalesce(kind, F.lit("")).isin("plain", "newnote"), "kind").when(size > most, "size")


def fingerprint(*parts: Column) -> Column:
    """Names a version of a file by what it is made of."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def delta(current: DataFrame, mirrored: DataFrame) -> DataFrame:
    """(path, action) between current and mirrored (path, fingerprint): put what is new or different, keep what is there
    already, remove what is no more."""
    a = current.select("path", F.col("fingerprint").alias("new"))
    b = mirrored.select("path", F.col("fingerprint").alias("old"))
    action = F.when(F.col("new").isNull(), "remove").when(F.col("new").eqNullSafe(F.col("old")), "keep").otherwise("put")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def decode(kind: Column, content: Column) -> Column:
    """Bytes of a file: text as UTF-8, binary notes from strict base64; null where that is broken."""
    return F.when(kind == "newnote", strict_base64(content)).otherwise(F.encode(content, "UTF-8"))


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes (path, bytes) under a folder that all executors share; (path, size) of what was written.

    Paths that are not safe are not written and have no row, nor are those that links lead out of the folder.  A file is
    written beside its place and renamed, so one that is written again is whole at any time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import tempfile

        top = os.path.realpath(root)
        for rows in batches:
            places = [os.path.realpath(os.path.join(top, path)) for path in rows["path"]]
            rows = rows[[place.startswith(top + os.sep) for place in places]]
            for path, data in zip(rows["path"], rows["bytes"], strict=True):
                place = os.path.join(top, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                handle, beside = tempfile.mkstemp(dir=os.path.dirname(place))
                with os.fdopen(handle, "wb") as out:
                    out.write(data)
                os.replace(beside, place)
            yield pd.DataFrame({"path": rows["path"], "size": rows["bytes"].map(len)})

    return files.where(is_safe(F.col("path"))).select("path", "bytes").mapInPandas(run, "path string, size long")


def status(state: DataFrame) -> DataFrame:
    """(status, files)."""
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def retry_delay(attempts: Column, jitter: Column) -> Column:
    """Seconds to the next try: doubling from five, at most a quarter of an hour, times a random share."""
    return F.least(F.lit(900.0), 5.0 * F.pow(F.lit(2.0), F.least(attempts, F.lit(8)))) * jitter
