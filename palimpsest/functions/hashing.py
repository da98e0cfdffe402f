"""Identifiers that are hashes, and texts in the units that they are measured in."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest piece of a note's content, of a stored body, and the size above which a body is split at all.
CONTENT_PIECE, BODY_PIECE, BODY_WHOLE = 100_000, 250_000, 1_000_000


# Fixed value: what a chunk's hash begins with, so that ids are the same wherever chunks are made.
CHUNK_HEAD = "kuro-chunk\n"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def utf16_length(text: Column) -> Column:
    """Code units, which count a character beyond the basic plane twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def chunk_id(piece: Column) -> Column:
    """The id of a content chunk: equal pieces share one."""
    named = F.concat(F.lit(CHUNK_HEAD), utf16_length(piece).cast("string"), F.lit("\n"), piece)
    return F.concat(F.lit("h:k"), F.substring(F.sha2(named, 256), 1, 40))


def vector_id(*parts: Column) -> Column:
    return F.concat(F.lit("v1:"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 60))


def split_units(text: str, size: int) -> Iterator[str]:
    """Pieces of ``size`` UTF-16 code units that never part a surrogate pair."""
    if text.isascii() or max(text) < "\U00010000":
        for a in range(0, len(text), size):
            yield text[a : a + size]
        return
    units, at = 0, 0
    for i, c in enumerate(text):
        n = 2 if c > "￿" else 1
        if units + n > size:
            yield text[at:i]
            units, at = 0, i
        units += n
    yield text[at:]


@F.pandas_udf(T.ArrayType(T.StringType()))
def content_pieces(text: pd.Series) -> pd.Series:
    """A note's content as chunk pieces; an empty text has none."""
    return text.map(lambda t: list(split_units(t, CONTENT_PIECE)) if t else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def body_pieces(body: pd.Series) -> pd.Series:
    """A stored body as pieces; null where it is small enough to stay whole."""
    return body.map(lambda t: list(split_units(t, BODY_PIECE)) if t is not None and len(t.encode("utf-8", "surrogatepass")) > BODY_WHOLE else None)


def number_text(x: float) -> str:
    """The shortest text that reads as the number again, as scripts print it."""
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == 0:
        return "0"
    digits, _, exponent = f"{abs(x):.17e}".partition("e")
    for precision in range(17):
        digits, _, exponent = f"{abs(x):.{precision}e}".partition("e")
        if float(f"{digits}e{exponent}") == abs(x):
            break
    digits, point = digits.replace(".", "").rstrip("0") or "0", int(exponent) + 1
    sign = "-" if x < 0 else ""
    if 0 < point <= 21:
        return sign + (digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def stable_json(value: Any) -> str:
    """JSON with sorted keys (by UTF-16 code unit) and numbers as scripts print them: equal bodies give equal text."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(stable_json, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{stable_json(value[k])}" for k in keys) + "}"


#: Fields that are about a revision, not of its body.
META = ("_rev", "_revisions", "_conflicts")


@F.pandas_udf(T.StringType())
def stable_body(body: pd.Series) -> pd.Series:
    """A JSON body without its revision fields, in stable form."""
    return body.map(lambda b: None if b is None else stable_json({k: v for k, v in json.loads(b).items() if k not in META}))


def revision_hash(stable: Column, parent: Column) -> Column:
    """32 digits that follow from the body and the parent, so equal edits of equal parents are the same revision."""
    return F.substring(F.sha1(F.concat(stable, F.lit("\n"), F.coalesce(parent, F.lit("")))), 1, 32)


def local_revision(stable: Column) -> Column:
    return F.concat(F.lit("0-"), F.substring(F.sha1(stable), 1, 16))


def rev_generation(rev: Column) -> Column:
    """The number before the dash; null where the text is no revision."""
    return F.when(rev.rlike(r"^\d+-.+$"), F.regexp_extract(rev, r"^(\d+)-", 1).cast("bigint"))


def rev_digest(rev: Column) -> Column:
    return F.when(rev.rlike(r"^\d+-.+$"), F.regexp_extract(rev, r"^\d+-(.+)$", 1))


def ancestor_revs(start: Column, ids: Column) -> Column:
    """Revisions named by a history (start, ids): ids[0] is the revision itself, generations fall by one and end at 1."""
    revs = F.transform(ids, lambda h, i: F.when(start - i >= 1, F.concat((start - i).cast("string"), F.lit("-"), h)))
    return F.array_compact(revs)


def plain_base64(data: Column) -> Column:
    """Base64 in one line: Spark's own is broken after each 76 characters, which ``strict_base64`` does not take."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def strict_base64(text: Column) -> Column:
    """Bytes of well-formed base64; null where the text is anything else."""
    good = text.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(good, F.unbase64(text))


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def fnv1a_hash(text: Column) -> Column:
    """The same number of a column, without Python."""
    size = F.octet_length(text)
    byte = lambda i: F.conv(F.substring(F.hex(text), 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    start = F.lit(0x811C9DC5).cast("bigint")
    fold = F.aggregate(F.sequence(F.lit(0), size - 1), start, lambda h, i: (h.bitwiseXOR(byte(i)) * 0x01000193).bitwiseAND(0xFFFFFFFF))
    return F.when(size == 0, start).otherwise(fold)


def term_shard(term: Column, shards: int = 16) -> Column:
    return (fnv1a_hash(term) % shards).cast("int")


def term_bucket(term: Column, buckets: int = 64) -> Column:
    """Independent of the shard, whose bits come first."""
    return (F.floor(fnv1a_hash(term) / 16) % buckets).cast("int")
