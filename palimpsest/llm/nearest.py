"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected to a few dimensions ``CURVES`` times, each time with another projection and shift, and ordered along a
Hilbert curve there.  Each ordering is range-partitioned and cut into blocks of equal length.  A query is compared with its
own block and the two beside it in every ordering, on the original vectors in double precision; what the orderings find is
merged and reranked: the best few more than K of each query are scored once more, by one sum in the order of the components,
so a score and its rank do not depend on how rows were batched.

The block length is fitted: the exact neighbours of a bounded sample of queries (``TUNE`` of them, against all rows, in
blocks) show how far along the nearest of the orderings a neighbour lies, and the blocks are as long as ``REACH`` of these
distances, in a table of any size.  On vectors with structure that is a small part of the table; on directionless noise, as in
the synthetic tables, no ordering is near and the blocks become a tenth of it.  Recall is what is held fixed.

Rows of the very same vector are one class in the index; a class stands for its K + 1 smallest ids, as no later one can be
among the K nearest of any query.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries or as
candidates, nor do vectors of another length than the first valid one by id; a null id takes no part.  With fewer than K
candidates all are returned; equal scores go to the smaller id.  A row that is repeated under its id is one row, as a query and
as a candidate; of different vectors under one id the smallest counts, by its components in order, and the id is a query if
any of its rows is.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, small_side
from .hilbert import hilbert_index

K, CURVES, DIMS, BITS, SEED = 20, 8, 6, 10, 20240501

#: Rows that the projections are scaled by, queries that the block length is fitted on, and the share of their neighbours
#: that must lie within one block.
SAMPLE, TUNE, REACH = 4096, 64, 0.96

#: Classes beyond K + 1 that are scored once more: what rounding may have put in another order.
SPARE = 8

#: Rows that are multiplied at once.
STEP = 4096


def _valid(v: Column) -> Column:
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """list<float> of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def classes_of(vectors: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Of (vec_id, v), each id once: members (vec_id, cls) and classes (cls, ids, v); cls is the smallest id of a vector."""
    named = cut(vectors.select("vec_id", "v", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).alias("h")))
    groups = named.groupBy("h").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups)
    members = cut(named.select("vec_id", "h").join(groups.select("h", "cls", "n"), "h").select("vec_id", "cls", "n"))
    # the smallest ids of a class: first within salted parts, so that a class of any size is ranked in parts
    shared = members.where("n > 1").withColumn("salt", F.pmod(F.hash("vec_id"), F.lit(64)))
    part = shared.withColumn("r", F.row_number().over(Window.partitionBy("cls", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    lists = first.groupBy("cls").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    reps = named.select(F.col("vec_id").alias("cls"), "v").join(groups.select("cls"), "cls", "left_semi")
    classes = reps.join(lists, "cls", "left").select("cls", F.coalesce("ids", F.array("cls")).alias("ids"), "v")
    return members.select("vec_id", "cls"), cut(classes)


class Curves:
    """The projections, fitted to a bounded sample."""

    def __init__(self, sample: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        n = sample.shape[1]
        dims = min(DIMS, n)
        self.centre = sample.mean(axis=0)
        self.axes = np.stack([np.linalg.qr(rng.normal(size=(n, dims)))[0] for _ in range(CURVES)])
        spread = np.einsum("ij,cjd->cid", sample - self.centre, self.axes)
        self.low, high = np.quantile(spread, 0.001, axis=1), np.quantile(spread, 0.999, axis=1)
        self.width = np.maximum(high - self.low, 1e-12)
        self.shift = rng.random((CURVES, dims)) * 0.3

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Curve positions, (CURVES, rows); values beyond the sample's range lie on the border of the grid."""
        out = []
        for c in range(CURVES):
            at = ((rows - self.centre) @ self.axes[c] - self.low[c]) / self.width[c]
            grid = np.clip((at + self.shift[c]) / 1.3, 0, 1) * ((1 << BITS) - 1)
            out.append(hilbert_index(grid.astype(np.uint64), BITS).astype(np.int64))
        return np.array(out)


def _ranks(classes: DataFrame, curves: Curves) -> DataFrame:
    """(cls, curve, rank): places in each ordering, from 0; equal positions are told apart by a hash of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = curves.keys(_matrix(batch.column(1))) if batch.num_rows else np.zeros((CURVES, 0), np.int64)
            cls = batch.column(0)
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([cls, pa.array(np.full(len(cls), c, np.int32)), pa.array(keys[c])], ["cls", "curve", "key"])

    keyed = classes.select("cls", "v").mapInArrow(lean(run), "cls long, curve int, key long").withColumn("tie", F.xxhash64("cls"))
    placed = keyed.repartitionByRange("curve", "key", "tie").sortWithinPartitions("curve", "key", "tie")
    placed = cut(placed.select("cls", "curve", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at")))
    parts = placed.groupBy("curve", "pid").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("curve").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select("curve", "pid", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return placed.join(small_side(parts), ["curve", "pid"]).select("cls", "curve", (F.col("at") - F.col("first") + F.col("base")).alias("rank"))


def _best(scores: np.ndarray, cls: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to the smaller class: (scores, classes), in no order."""
    if scores.shape[1] <= k:
        return scores, cls
    # what ties with the k-th best must not be cut off by chance
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(scores, at, 1).min(axis=1)
    tied = np.flatnonzero((scores >= edge[:, None]).sum(axis=1) > k)
    for i in tied:
        at[i] = np.lexsort((cls[i], -scores[i]))[:k]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(cls, at, 1)


def _compare(queries: np.ndarray, rows: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best classes for each query among rows (cls, matrix) that stream by."""
    best, who = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64)
    for cls, matrix in rows:
        parts = []
        for a in range(0, len(queries), STEP):
            part = slice(a, a + STEP)
            s, w = _best(queries[part] @ matrix.T, np.broadcast_to(cls, (len(queries[part]), len(cls))), k)
            parts.append((s, w))
        s, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        best, who = _best(np.concatenate((best, s), 1), np.concatenate((who, w), 1), k)
    return best, who


def _exact(classes: DataFrame, queries: np.ndarray, names: np.ndarray, k: int) -> DataFrame:
    """(q, cls, score) of the k nearest classes of a few queries, against all rows."""
    ids = names.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for a in range(0, batch.num_rows, STEP):
                    part = batch.slice(a, STEP)
                    yield part.column(0).to_numpy(), _matrix(part.column(1))

        best, who = _compare(queries, rows(), k)
        q = np.repeat(ids, best.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(who.ravel()), pa.array(best.ravel())], ["q", "cls", "score"])

    found = classes.select("cls", "v").mapInArrow(lean(run), "q long, cls long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _block_length(classes: DataFrame, ranks: DataFrame, asked: DataFrame, n: int, k: int) -> int:
    sample = asked.orderBy(F.xxhash64("cls"), "cls").limit(TUNE).collect()
    names = np.array([r["cls"] for r in sample], np.int64)
    exact = _exact(classes, np.array([r["v"] for r in sample], np.float64), names, k + 1).where("q <> cls")
    # a neighbour is as far as it is in the ordering where it is nearest
    q = ranks.select(F.col("cls").alias("q"), "curve", F.col("rank").alias("qr"))
    far = exact.join(ranks, "cls").join(q, ["q", "curve"]).groupBy("q", "cls").agg(F.min(F.abs(F.col("rank") - F.col("qr"))).alias("d")).collect()
    reach = int(np.quantile([r["d"] for r in far], REACH)) + 1 if far else 1
    return min(reach, max(n, 1))


def _one_row_each(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, v, asks) with each id once; only rows of repeated ids travel with their vectors."""
    again = cut(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    again = small_side(again)
    merged = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    return cut(rows.join(again, "vec_id", "left_anti").unionByName(merged))


def _rescored(hits: DataFrame, classes: DataFrame) -> DataFrame:
    """hits (q, cls) with the inner product of their vectors, summed in order."""
    of = classes.select("cls", "v")
    both = hits.select("q", "cls").join(of, "cls").join(of.select(F.col("cls").alias("q"), F.col("v").alias("w")), "q")
    products = F.zip_with("v", "w", lambda x, y: x.cast("double") * y.cast("double"))
    return both.select("q", "cls", F.aggregate(products, F.lit(0.0), lambda a, x: a + x).alias("score"))


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull() & _valid(F.col(embedding))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(rows)
    first = rows.select(F.min_by(F.size("v"), F.col("vec_id")).alias("dims")).first().dims
    rows = _one_row_each(rows.where(F.size("v") == F.lit(first if first is not None else 0)))
    members, classes = classes_of(rows.select("vec_id", "v"), k)
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where("asks").select("vec_id").join(members, "vec_id")
    asked = cut(classes.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", "v"))
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("v").collect()
    curves = Curves(np.array([r["v"] for r in sample], np.float64))
    ranks = cut(_ranks(classes, curves))
    length = _block_length(classes, ranks, asked, n, k)
    block = F.floor(F.col("rank") / length)
    data = ranks.select("cls", "curve", block.alias("block"), F.lit(1).alias("kind")).join(classes.select("cls", "v"), "cls")
    near = ranks.join(asked, "cls").select("cls", "curve", F.explode(F.array(block - 1, block, block + 1)).alias("block"), F.lit(0).alias("kind"), "v")
    both = data.select("curve", "block", "kind", "cls", "v").unionByName(near.where(F.col("block") >= 0).select("curve", "block", "kind", "cls", "v"))
    both = both.repartition("curve", "block").sortWithinPartitions("curve", "block", "kind", "cls")

    most = k + 1 + SPARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple[int, int], int, np.ndarray, np.ndarray]]:
            """Runs of one block and kind, STEP rows at most."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                curve, place, kind, cls = (batch.column(i).to_numpy() for i in range(4))
                edge = np.flatnonzero((np.diff(curve) != 0) | (np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
                for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [batch.num_rows])), strict=True):
                    for s in range(a, b, STEP):
                        size = min(STEP, b - s)
                        yield (int(curve[s]), int(place[s])), int(kind[s]), cls[s : s + size], _matrix(batch.column(4).slice(s, size))

        def out(who: list, best: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
            q = np.repeat(np.concatenate(who), best.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(found.ravel()), pa.array(best.ravel())], ["q", "cls", "score"])

        now, who, asking, best, found = None, [], [], None, None
        for at, kind, cls, matrix in pieces():
            if at != now:
                if best is not None:
                    yield out(who, best, found)
                now, who, asking, best, found = at, [], [], None, None
            if kind == 0:
                who.append(cls)
                asking.append(matrix)
            elif who:
                if best is None:
                    stacked = np.concatenate(asking)
                    best, found = np.zeros((len(stacked), 0)), np.zeros((len(stacked), 0), np.int64)
                s, w = _compare(stacked, iter([(cls, matrix)]), most)
                best, found = _best(np.concatenate((best, s), 1), np.concatenate((found, w), 1), most)
        if best is not None:
            yield out(who, best, found)

    hits = both.mapInArrow(lean(run), "q long, cls long, score double").groupBy("q", "cls").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    hits = cut(hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r"))
    hits = _rescored(hits, classes).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    # k + 1 ids at most for a class of queries: one may be the query itself
    ids = hits.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = ids.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    answers = queries.select(F.col("vec_id").alias("query_id"), F.col("cls").alias("q")).join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
