"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

The mix has as many words as the corpus.  It is cut into blocks of equal size; blocks go to sources, then within a
source to its shards, by the highest quotients target / (2 seats + 1).  A shard of q blocks' quota lays its documents in
a seeded order on a line and takes the first q blocks' words of it, going round again where the quota is above its size.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a source of its own, after all
others; a null doc_id is one like any other; repeated rows are documents each (they stand side by side in the order).
An empty table gives an empty result.  A source of no words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, small_side

#: Weights by rank of the source, repeating; a target stops at so many times what the source has.
WEIGHTS, MOST = (1, 2, 3), 3

#: Words of a block, words of a shard (a shard holds one document at least) and the seed of the order.
BLOCK, SHARD, SEED = 64, 100_000, "mix-1"

#: Shards of a source; above it shards get longer, not more, so that apportioning them stays one small sort.
SHARDS_MOST = 65_536


def targets(sources: DataFrame) -> DataFrame:
    """(skey, n, size) of each source to (skey, size, target).  One row per source: windows over them stay small."""
    ranked = sources.withColumn("_i", F.row_number().over(Window.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("_i") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("size") * F.lit(float(MOST)))
    # sources stop at their caps in the order of cap / weight; the level that the rest rises to follows from prefix sums
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "skey")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (
        ranked.withColumn("_total", F.sum("size").over(every).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    )
    # the level if all sources before this one are at their caps; it stands where this one is still below its own
    level = (F.col("_total") - F.col("_capped")) / F.col("_left")
    ranked = ranked.withColumn("_at", F.row_number().over(order)).withColumn("_try", F.when(level * F.col("_w") <= F.col("_cap"), level))
    ranked = ranked.withColumn("_level", F.min_by("_try", F.when(F.col("_try").isNotNull(), F.col("_at"))).over(every))
    target = F.when(F.col("_total") > 0, F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))).otherwise(F.lit(0.0))
    return ranked.select("skey", "size", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], name: str, votes: str, seats: str, out: str, most: str | None = None) -> DataFrame:
    """``parties`` with the integer seats that the highest quotients give each; ``seats`` of the group go round.

    Seats far below the last one given are given outright; the quotients near it are ranked.  The band that is ranked
    has as many seats as a group has parties, times a constant, so the work is in proportion to the parties.
    """
    of = Window.partitionBy(*group)
    p = parties.withColumn("_votes", F.sum(votes).over(of)).withColumn("_m", F.count(F.lit(1)).over(of))
    fair = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes") * F.col(seats)).otherwise(F.lit(0.0))
    half = F.ceil((F.col("_m") + 1) * F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(F.lit(0.0))) + 2
    p = p.withColumn("_low", F.greatest(F.floor(fair) - half, F.lit(0)).cast("long")).withColumn("_high", (F.floor(fair) + half + 1).cast("long"))
    p = p.withColumn("_rest", F.col(seats) - F.sum("_low").over(of))
    tries = p.where(F.col(votes) > 0).select(*group, name, "_low", "_rest", F.explode(F.sequence("_low", "_high")).alias("_j"), F.col(votes).alias("_v"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_v") / (2 * F.col("_j") + 1)).desc(), F.col(name), F.col("_j")))
    won = tries.withColumn("_r", rank).where(F.col("_r") <= F.col("_rest")).groupBy(*group, name).agg(F.count(F.lit(1)).alias("_won"))
    on = [F.col("a." + c).eqNullSafe(F.col("b." + c)) for c in (*group, name)]
    joined = p.alias("a").join(won.alias("b"), on, "left")
    return joined.select(*(F.col("a." + c) for c in parties.columns), (F.col("a._low") + F.coalesce(F.col("b._won"), F.lit(0))).cast("long").alias(out))


def _key(source: Column) -> Column:
    """Sorts by code point with null last and joins as an ordinary string."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard_words: int = SHARD, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(source)).alias("skey"), count_words(F.col(text)).alias("size"), order.alias("turn")))
    return _mix(sized, block, shard_words)


def _mix(sized: DataFrame, block: int, shard_words: int) -> DataFrame:
    sources = targets(sized.groupBy("skey").agg(F.sum("size").alias("size")))
    sources = sources.withColumn("shards", F.greatest(F.least(F.ceil(F.col("size") / shard_words), F.lit(SHARDS_MOST)), F.lit(1)).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.sum("size").over(Window.partitionBy()) / block).cast("long")).withColumn("g", F.lit(0))
    sources = cut(sainte_lague(sources, ["g"], "skey", "target", "blocks", "quota").select("skey", F.col("size").alias("source_size"), "target", "shards", "quota"))
    placed = sized.join(small_side(sources), "skey")
    placed = placed.withColumn("shard", F.pmod(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = placed.groupBy("skey", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = cut(sainte_lague(shards, ["skey"], "shard", "shard_size", "quota", "shard_quota").select("skey", "shard", "shard_size", "shard_quota"))
    placed = placed.join(small_side(shards), ["skey", "shard"])
    # a shard gives what its quota has of words, three times its own at most
    words = F.least(F.col("shard_quota") * block, F.col("shard_size") * MOST)
    line = Window.partitionBy("skey", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_words", words).withColumn("_end", F.sum("size").over(line))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("_words") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("_words") - rounds * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("_end"), rest) - (F.col("_end") - F.col("size")))
    return placed.select("doc_id", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))
