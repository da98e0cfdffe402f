"""URL filters by a Bloom filter cascade.

Level 1 of a cascade encodes the listed keys.  Keys of the corpus that pass it without being listed are encoded in
level 2; listed keys that pass level 2 are encoded in level 3, and so on until no key passes wrongly.  As the levels
were made against every key that the corpus has, a lookup is exact for this corpus, and it is a chain of bit tests
inside the scan: no join, no shuffle of urls.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, verdict ``allow``.  Repeated
rows are judged alike.  An empty table gives an empty result.  A host of any number of labels is looked at by its last
labels only, as many as the longest listed host has.  Of several fitting rules of one length the greatest by code point
decides.  A level is part of the plan, about 16 characters for each 5 keys: lists of up to some hundred thousand rules.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

# The rules of the contract, as (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Bits for each encoded key and hash functions for each level.
BITS_PER_KEY, HASHES = 12, 4


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty where the url is null or has no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = ascii_lower(F.regexp_extract(url, parts, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def _split_key(key: str) -> tuple[str, str]:
    host, _, path = key.partition("/")
    return host, "/" + path if "/" in key else ""


class Keys:
    """Which substrings of a url can equal a listed key: the last labels of its host with a prefix of its path."""

    def __init__(self, listed: Sequence[str]):
        parts = [_split_key(k) for k in listed]
        self.labels = sorted({host.count(".") + 1 for host, _ in parts})
        self.lengths = sorted({len(path) for _, path in parts})

    def of(self, host: Column, path: Column) -> Column:
        """array<string> of the candidate keys, distinct, without nulls."""
        found = []
        for n in self.labels:
            # fewer labels than n: that suffix does not exist
            suffix = F.when(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= n - 1, F.substring_index(host, ".", -n))
            for k in self.lengths:
                found.append(F.when(F.length(path) >= k, F.concat(suffix, F.substring(path, 1, k))))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


class Cascade:
    """Exact membership of a column's keys in a list, for keys of the universe that it was built over."""

    def __init__(self, levels: list[tuple[int, list[int]]]):
        self.levels = levels

    @staticmethod
    def _bits(key: Column, level: int, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(level * HASHES + j), key), F.lit(bits).cast("long")) for j in range(HASHES)]

    @classmethod
    def _passes(cls, key: Column, level: int, bits: int, words: list[int]) -> Column:
        # one string literal that constant folding turns into one array literal
        table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
        tests = [F.call_function("shiftright", F.element_at(table, (at / 64).cast("int") + 1), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1 for at in cls._bits(key, level, bits)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    @classmethod
    def _encode(cls, keys: DataFrame, level: int, n: int) -> tuple[int, list[int]]:
        """The bits of a level; what comes to the driver is the level itself, of a size known from the count."""
        bits = 64 * max(1, math.ceil(n * BITS_PER_KEY / 64))
        at = keys.select(F.explode(F.array(*cls._bits(F.col("key"), level, bits))).alias("at"))
        rows = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("value")).collect()
        words = [0] * (bits // 64)
        for r in rows:
            words[r.word] = r.value
        return bits, words

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """``listed`` and ``universe``: distinct keys in a column ``key``."""
        inside, outside, levels = listed, universe.join(listed, "key", "left_anti"), []
        while (n := inside.count()) > 0:
            levels.append(cls._encode(inside, len(levels), n))
            passed = cls._passes(F.col("key"), len(levels) - 1, *levels[-1])
            # those that pass wrongly are what the next level encodes
            inside, outside = cut(outside.where(passed)), inside
        return cls(levels)

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self._passes(key, i, *self.levels[i]), F.lit(i % 2 == 1)).otherwise(out)
        return out


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of ``pages``, then host, path, rule, verdict.

    A rule ``host/path`` fits that host and its subdomains where the path starts with the rule's; the longest fitting
    one decides.  A url that no rule fits is not a member of the cascade of blocked keys, so the verdict is ``allow``.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    seen = pages.select(*(F.col(c) for c in keep), host.alias("_host"), path.alias("_path"))
    keys = Keys([k for _, k in rules])
    candidates = keys.of(F.col("_host"), F.col("_path"))
    universe = cut(seen.select(F.explode(F.array_distinct(candidates)).alias("key")).distinct())
    cascades = {}
    for verdict in ("block", "allow"):
        listed = sorted({k for v, k in rules if v == verdict})
        cascades[verdict] = Cascade.build(spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    hit = F.transform(
        F.col("_keys"),
        lambda k: F.when(cascades["allow"].contains(k), F.struct(F.length(k).alias("n"), k.alias("key"), F.lit("allow").alias("verdict"))).when(
            cascades["block"].contains(k), F.struct(F.length(k).alias("n"), k.alias("key"), F.lit("block").alias("verdict"))
        ),
    )
    best = F.array_max(F.array_compact(hit))
    return (
        seen.withColumn("_keys", candidates)
        .withColumn("_best", best)
        .select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.key").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit("allow")).alias("verdict"))
    )
