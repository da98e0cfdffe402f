"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document's set has its distinct shingles of five words (with fewer words, the whole sequence as one).  Documents of the
same set are one class; what follows works on classes only, so exact copies never meet each other.

* Forest: a signature of ``SLOTS`` values is read in ``TREES`` orders, each of which sorts the classes.  Classes that share
  the first ``DEPTH`` values of an order are a region.  In a region of up to ``REGION`` classes all are candidates of each
  other.  A larger one is read as deep as its classes differ: they are sorted by the order's further values, and a class's
  candidates are those around it, the longest common prefixes: half a ``REGION`` on either side at least, which holds every
  class of any deeper region of that size.
* Round 1: each class takes its most similar earlier candidate, one pair for each class.  Pairs are confirmed on the full
  sets and followed to their roots.
* Round 2: classes that still have a candidate under another root bring their whole sets, as 32-bit hashes, to the buckets
  they share with it, where all those pairs are compared at once; what is similar there, or as near to it as shorter hashes
  can tell, is confirmed on the full sets, and the links between roots give the components.  A set travels to the buckets
  of its class, of which there is a fixed number, not to each of its candidates.
* Round 3: a region of more than a ``REGION`` whose classes are not all tied by now is left with pairs that its windows did
  not show.  The classes of such regions are joined exactly, by prefixes: their shingles are put in one order, rare ones
  first, and two similar sets share one of those that each has first, however many have it too (``_prefixes``).  Classes
  with such a shingle in common are all compared, on their full sets.  Where that is less work, all classes that chains of
  such shingles tie are compared instead (``_groups``), and of up to ``WHOLE`` classes all are.  What is too large for one task is cut into blocks, and every two
  blocks that have similar sizes meet in one (``_tiles``): nothing is left out, at a work that grows with the square of the
  number of classes where they have no rare shingles to tell them apart.

Only pairs whose signatures agree in four deviations less than the threshold are confirmed, in round 3 six.  With 20 orders
of depth 4 a pair at a similarity of 0.85 is missed by the orders with a probability of 4e-7, at 0.8 of 3e-5; in dense
regions too, as every pair that meets in one is either compared or tied by others.

Defined results: a null or wordless text has an empty set and is linked with nothing; a null doc_id is linked with nothing,
has a null component and stays; repeated rows are of one class, and each has its row in the result; an empty table gives an
empty result; other columns are ignored.  Texts are hashed whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import numbered
from .common import cut, lean, shuffle_partitions, small_side

WORDS, PERCENT = 5, 85
SLOTS, TREES, DEPTH, STEP = 128, 20, 4, 6
REGION = 96

#: Values of an order that sort a dense region.
SORTED = 64

#: Classes that round 3 compares all with each other, with no prefixes, and slots of shingles that it ranks for more.
WHOLE, SKETCH = 4096, 1 << 20

#: Classes of a block in round 3, and shingles of all its sets (at least one class).
BLOCK, BLOCK_SHINGLES = 512, 1 << 21

#: Short hashes of one pair that may coincide by chance without a link being lost.
SLACK = 3

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x100000001B3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles, computed for all of its words at once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power, self.inverse = (np.cumprod(np.full(n + 1, p, np.uint64), dtype=np.uint64) for p in (_P, pow(_P, -1, 1 << 64)))

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)  # bytes.lower() is A-Z only
        if len(data) + 1 > len(self.power):
            self._grow(2 * len(data))
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            # a word's hash: the sum of byte * P^place over its bytes, shifted back to place 0
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)))
            word = _mix((total[stop] - total[start]) * self.inverse[start] + (stop - start).astype(np.uint64))
            n = self.words
            if len(word) < n:
                h = np.array([len(word)], np.uint64)
                for w in word:
                    h = _mix(h * _M2 + w)
                return h
            h = np.full(len(word) - n + 1, n, np.uint64)
            for k in range(n):
                h = _mix(h * _M2 + word[k : len(word) - n + 1 + k])
        return np.unique(h)


class Signer:
    """Signatures of ``SLOTS`` values of 16 bits, and their keys in each order of the forest."""

    def __init__(self):
        seeds = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, size=(3, SLOTS), dtype=np.uint64)
        self.flip, self.odd = seeds[0], (seeds[1] << np.uint64(1)) | np.uint64(1)
        self.orders = np.array([[(t * STEP + k) % SLOTS for k in range(SLOTS)] for t in range(TREES)])
        self.weights = (seeds[2] << np.uint64(1)) | np.uint64(1)
        self.salt = _mix(np.arange(1, TREES + 1, dtype=np.uint64) * _M1)

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, len(hashes), 512):
                low = np.minimum(low, ((hashes[a : a + 512, None] ^ self.flip) * self.odd).min(axis=0))
            return (_mix(low) >> np.uint64(48)).astype(np.uint16)

    def keys(self, signature: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """One 64-bit key per order, of the first ``depth`` values in it."""
        with np.errstate(over="ignore"):
            values = signature[self.orders[:, :depth]].astype(np.uint64) + np.uint64(1)
            return _mix((_mix(values * self.weights[:depth]) * self.weights[:depth]).sum(axis=1, dtype=np.uint64) + self.salt * np.uint64(depth)).view(np.int64)


def _set_id(hashes: np.ndarray) -> bytes:
    """128 bits that name a set: two sums over independent mixes, with its size."""
    with np.errstate(over="ignore"):
        a = _mix(hashes + _M1).sum(dtype=np.uint64) + np.uint64(len(hashes))
        b = _mix(hashes * _M2).sum(dtype=np.uint64)
    return np.array([a, b], ">u8").tobytes()


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cid, sig, keys, text_hash) of every document; cid to keys are null for an empty set."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signer = Shingles(), Signer()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, cid, sig, keys = [], [], [], []
                for t in part.column(1):
                    h = shingles(t.as_py())
                    n.append(len(h))
                    s = signer.sign(h) if len(h) else None
                    cid.append(_set_id(h) if len(h) else None)
                    sig.append(None if s is None else s.tobytes())
                    keys.append(None if s is None else signer.keys(s))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64())), part.column(2)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "cid", "sig", "keys", "text_hash"])

    return source.mapInArrow(lean(run), f"doc_id {source.schema[0].dataType.simpleString()}, n_shingles long, cid binary, sig binary, keys array<long>, text_hash long")


def _sorted_windows(dense: DataFrame) -> DataFrame:
    """(cid, bucket) of (cid, tree, key, sig) in dense regions: every class beside its neighbours in the sorted order.

    A region's order is cut into blocks of half a ``REGION``; a bucket has two blocks that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Signer().orders[:, DEPTH : DEPTH + SORTED]
        for batch in batches:
            sig = np.array([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(3)]).reshape(-1, SLOTS)
            values = np.take_along_axis(sig, orders[batch.column(1).to_numpy()], axis=1).astype(">u2")
            place = pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), place], ["cid", "tree", "key", "place"])

    keyed = dense.select("cid", "tree", "key", "sig").mapInArrow(lean(run), "cid binary, tree int, key long, place binary")
    placed = numbered(keyed, "at", "tree", "key", "place", "cid")
    block = F.floor(F.col("at") / (REGION // 2))
    return placed.select("cid", F.explode(F.array(F.xxhash64("key", block), F.xxhash64("key", block + 1))).alias("bucket"))


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(cid, sig, bucket) of the classes that share a bucket with another one, and (cid, key) of those in dense regions."""
    spread = classes.select("cid", F.posexplode("keys").alias("tree", "key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # classes that no order puts beside another one leave here, before signatures travel
    met = cut(spread.join(shared, "key").select("cid", "tree", "key", "n"))
    sigs = classes.select("cid", "sig")
    small = met.where(F.col("n") <= REGION).select("cid", F.col("key").alias("bucket"))
    large = met.where(F.col("n") > REGION)
    if large.isEmpty():
        return small.join(sigs, "cid"), None
    dense = _sorted_windows(large.join(sigs, "cid"))
    return small.unionByName(dense).join(sigs, "cid"), large.select("cid", "key")


def _unsettled(large: DataFrame, tops: DataFrame) -> DataFrame:
    """(cid) of the classes in those dense regions, (cid, key), that are not all under one top, (cid, top)."""
    rows = cut(large.join(tops.select("cid", "top"), "cid"))
    mixed = cut(rows.groupBy("key").agg(F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo <> hi").select("key"))
    return cut(rows.join(small_side(mixed), "key").select("cid").distinct())


def _ranks(sets: DataFrame) -> np.ndarray:
    """Ranks of ``SKETCH`` slots of shingles, by how many shingles of (cid, hashes) fall into each: 0 where it is one, then the
    rare ones; slots that the same classes have share a rank.  The driver sees one row per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, who = np.zeros(SKETCH, np.int64), np.zeros(SKETCH, np.uint64)
        for batch in batches:
            for cid, data in zip(batch.column(0), batch.column(1), strict=True):
                slot = np.frombuffer(data.as_buffer(), np.uint64) & np.uint64(SKETCH - 1)
                np.add.at(n, slot, 1)
                np.bitwise_xor.at(who, slot, np.frombuffer(cid.as_buffer(), np.uint64)[0])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(who[at].view(np.int64))], ["slot", "n", "who"])

    parts = sets.select("cid", "hashes").mapInArrow(lean(run), "slot long, n long, who long")
    found = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.bit_xor("who").alias("who")).where("n > 1").toArrow()
    slot, n, who = (found.column(k).to_numpy() for k in ("slot", "n", "who"))
    by = np.lexsort((who, n))
    new = np.ones(len(by), bool)
    new[1:] = (n[by][1:] != n[by][:-1]) | (who[by][1:] != who[by][:-1])
    ranks = np.zeros(SKETCH, np.int32)
    ranks[slot[by]] = np.cumsum(new)
    return ranks


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, size, bucket, n) of (cid, hashes), one row a class: two classes that are similar enough share a bucket; n classes
    have it.

    All shingles are put in one order, by the ranks of their slots.  The first shingle that two sets share in it has all
    others that they share behind it in both, so at least as many as they must share.  That bounds its place in each, and
    what sizes it can be of use with.  This holds in any order; with rare shingles first, few classes meet."""
    ranks = _ranks(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sizes, places, buckets = [], [], [], []
            for cid, data in zip(batch.column(0), batch.column(1), strict=True):
                h = np.frombuffer(data.as_buffer(), np.uint64)
                rank = ranks[h & np.uint64(SKETCH - 1)]
                first = rank[np.lexsort((h, rank))[: len(h) + 1 + -percent * len(h) // 100]]
                bucket, place = np.unique(first, return_index=True)
                # shingles that no other class has come first of all
                bucket, place = bucket[bucket > 0], place[bucket > 0]
                cids += [cid.as_py()] * len(bucket)
                sizes += [len(h)] * len(bucket)
                places.append(place)
                buckets.append(bucket)
            if cids:
                columns = [pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (places, buckets))]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "size", "place", "bucket"])

    first = cut(sets.select("cid", "hashes").mapInArrow(lean(run), "cid binary, size long, place long, bucket long"))
    span = small_side(cut(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).where("n > 1")), 1_000_000)
    fits = ((100 + percent) * (F.col("size") - F.col("place")) >= percent * (F.col("size") + F.col("lo"))) & (percent * F.col("size") <= 100 * F.col("hi"))
    kept = cut(first.join(span.drop("n"), "bucket").where(fits).select("cid", "size", "bucket"))
    sizes = small_side(cut(kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), 1_000_000)
    return cut(kept.join(sizes, "bucket").select("cid", "size", "bucket", "n"))


def _groups(prefixes: DataFrame) -> DataFrame:
    """(cid, size, group) of the classes to compare with each other: those of a bucket, or those that buckets tie in chains
    where these have fewer pairs than their buckets.  A trip of a set to a bucket counts as a ``REGION`` of pairs."""
    hubs = prefixes.groupBy("bucket").agg(F.min("cid").alias("b"))
    tied = components(prefixes.select(F.col("cid").alias("a"), "bucket").join(hubs, "bucket").select("a", "b"))
    rows = cut(prefixes.join(tied.withColumnRenamed("a", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    # chains are weighed from their classes' sums: no task counts one chain's classes
    each = rows.groupBy("root", "cid").agg(F.sum(F.col("n") + REGION).alias("work"))
    work = each.groupBy("root").agg(F.sum("work").alias("work"), F.count(F.lit(1)).cast("double").alias("n"))
    whole = small_side(cut(work.where(F.col("n") * F.col("n") <= F.col("work")).select("root", F.lit(True).alias("whole"))))
    group = F.when(F.col("whole"), F.xxhash64(F.lit("whole"), "root")).otherwise(F.col("bucket"))
    return cut(rows.join(whole, "root", "left").select("cid", "size", group.alias("group")).distinct())


def _tiles(groups: DataFrame, percent: int) -> DataFrame:
    """(cid, bucket): every two classes of a group whose sizes allow it share a bucket of two blocks at most.

    Classes of like sizes are dealt into blocks, and each block meets the others of its sizes and those of the next."""
    total = small_side(cut(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))), 1_000_000)
    rows = groups.join(total, "group")
    one = (F.col("n") <= REGION) | ((F.col("n") <= BLOCK) & (F.col("weight") <= BLOCK_SHINGLES))
    small = rows.where(one).select("cid", F.col("group").alias("bucket"))
    # similar sizes are at most one step apart; a little more than the ratio, for rounding
    step = F.floor(F.log(F.col("size").cast("double")) / (np.log(100 / percent) + 1e-3))
    large = rows.where(~one).select("cid", "size", "group", step.alias("step"))
    needed = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    blocks = large.groupBy("group", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).select("group", "step", needed.alias("blocks"))
    # a step is seen by itself and by those on either side
    sides = {-1: "above", 0: "blocks", 1: "below"}
    seen = F.explode(F.array(*(F.struct((F.col("step") + d).alias("step"), F.lit(d).alias("side"), "blocks") for d in sides)))
    around = blocks.select("group", seen.alias("e")).select("group", "e.*").groupBy("group", "step")
    around = around.agg(*(F.coalesce(F.max(F.when(F.col("side") == d, F.col("blocks"))), F.lit(0)).alias(name) for d, name in sides.items()))
    dealt = large.join(around, ["group", "step"]).withColumn("at", F.pmod(F.xxhash64("cid"), F.col("blocks")))

    def meets(many, tile):
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(many)), lambda k: F.when(k < F.col(many), tile(k)))

    # a block alone with its sizes meets itself; among several, any of its tiles has all its pairs
    same = meets("blocks", lambda k: F.when((F.col("blocks") == 1) | (k != F.col("at")), F.xxhash64("group", "step", F.lit("same"), F.least("at", k), F.greatest("at", k))))
    below = meets("below", lambda k: F.xxhash64("group", F.col("step") - 1, F.lit("next"), k, "at"))
    above = meets("above", lambda k: F.xxhash64("group", "step", F.lit("next"), "at", k))
    tiled = dealt.select("cid", F.explode(F.concat(same, below, above)).alias("bucket")).where("bucket is not null")
    return small.unionByName(tiled)


Bucket = tuple[int, list[bytes], list[bytes], list]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    """Buckets of sorted rows (bucket, cid, value, root), each class once: bucket, cids, values, roots."""
    now, cids, values, roots = None, [], [], []
    for batch in batches:
        for bucket, cid, value, root in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if bucket != now:
                if len(cids) > 1:
                    yield now, cids, values, roots
                now, cids, values, roots = bucket, [], [], []
            if not cids or cids[-1] != cid:
                cids.append(cid)
                values.append(value)
                roots.append(root)
    if len(cids) > 1:
        yield now, cids, values, roots


def _by_bucket(rows: DataFrame, value: str, spread: bool = False) -> DataFrame:
    """Rows dealt by bucket; ``spread`` keeps all partitions, for buckets that take longer than their bytes tell."""
    parts = [shuffle_partitions(rows.sparkSession)] if spread else []
    return rows.select("bucket", "cid", value, "root").repartition(*parts, "bucket").sortWithinPartitions("bucket", "cid")


def _closest(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, same): for each class and bucket the earlier class whose signature agrees most, where that is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cids, sigs, _ in _runs(batches):
            s = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(cids), SLOTS)
            out = []
            for i in range(1, len(cids)):
                same = (s[:i] == s[i]).sum(axis=1)
                j = int(same.argmax())
                if same[j] >= least:
                    out.append((cids[i], cids[j], int(same[j])))
            if out:
                a, b, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int32())], ["a", "b", "same"])

    return _by_bucket(rows.withColumn("root", F.lit(None).cast("binary")), "sig").mapInArrow(lean(run), "a binary, b binary, same int")


def _open(rows: DataFrame, least: float, spread: bool = False) -> DataFrame:
    """(bucket, cid, root) of the classes that have a candidate under another root in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, cids, sigs, roots in _runs(batches):
            names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
            if len(names) < 2:
                continue
            under = np.array([names[r] for r in roots])
            s = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(cids), SLOTS)
            has = np.array([bool((((s == s[i]).sum(axis=1) >= least) & (under != under[i])).any()) for i in range(len(cids))])
            if has.any():
                keep = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(keep), pa.int64()), *(pa.array([x[i] for i in keep], pa.binary()) for x in (cids, roots))], ["bucket", "cid", "root"])

    return _by_bucket(rows, "sig", spread).mapInArrow(lean(run), "bucket long, cid binary, root binary")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections at once, from the incidence of values in sets, in blocks of columns."""
    sizes = np.array([len(x) for x in sets])
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # values of one set alone are in no intersection but its own
    shared = n > 1
    row, at = row[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    wide, many = max(1, (1 << 22) // len(sets)), int(shared.sum())
    for a in range(0, many, wide):
        lo, hi = np.searchsorted(at, (a, a + wide))
        block = np.zeros((len(sets), min(wide, many - a)), np.float32)
        block[row[lo:hi], at[lo:hi] - a] = 1
        out += block @ block.T
    np.fill_diagonal(out, sizes)
    return out.astype(np.int64)


def _similar_in_buckets(rows: DataFrame, percent: int, kind: type = np.uint32, slack: int = SLACK, spread: bool = False) -> DataFrame:
    """Pairs (a, b) of (bucket, cid, hashes, root) under different roots whose sets of hashes are similar enough, or would be
    if ``slack`` of them fell together; of pairs that surely are, as many as tie what they tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cids, data, roots in _runs(batches):
            sets = [np.frombuffer(x, kind) for x in data]
            both = _intersections(sets)
            size = both.diagonal()
            union = size[:, None] + size[None, :] - both
            excess = 100 * both - percent * union
            top = {r: r for r in roots}

            def find(x):
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            a, b = [], []
            # the surest first, so that doubtful pairs are left only between what nothing else ties
            i, j = np.nonzero(np.tril(excess >= -100 * slack, -1))
            for k in np.argsort(-excess[i, j], kind="stable"):
                x, y = find(roots[i[k]]), find(roots[j[k]])
                if x == y:
                    continue
                a.append(cids[i[k]])
                b.append(cids[j[k]])
                if excess[i[k], j[k]] >= 100 * slack:
                    top[x] = y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return _by_bucket(rows, "hashes", spread).mapInArrow(lean(run), "a binary, b binary").distinct()


def _sets(cids: DataFrame, members: DataFrame, docs: DataFrame, short: bool = False) -> DataFrame:
    """(cid, hashes) of the classes named in ``cids``, from their documents' texts: 64-bit hashes, or their upper halves, as
    bytes."""
    wanted = small_side(cut(members.join(cids.distinct(), "cid", "left_semi")))
    texts = docs.join(wanted, "doc_id").select("cid", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(t.as_py()) for t in part.column(1)]
                # a doc_id may have other texts too: only the set that the class is named after counts
                keep = [i for i, h in enumerate(found) if len(h) and _set_id(h) == part.column(0)[i].as_py()]
                out = [np.unique((found[i] >> np.uint64(32)).astype(np.uint32)) if short else found[i] for i in keep]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([x.tobytes() for x in out], pa.binary())], ["cid", "hashes"])

    return texts.mapInArrow(lean(run), "cid binary, hashes binary")


def _confirmed(pairs: DataFrame, members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough.  ``members``: (doc_id, cid), one per class."""
    full = cut(_sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")), members, docs, short=False))
    both = pairs.join(full.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), "a").join(full.select(F.col("cid").alias("b"), F.col("hashes").alias("hb")), "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                union = len(np.unique(np.concatenate((x, y))))
                if 100 * (len(x) + len(y) - union) >= percent * union:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["a", "b"])

    return both.select("a", "b", "ha", "hb").mapInArrow(lean(similar), "a binary, b binary").distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """(a, b) with b earlier than a, one row per a, followed to (a, root) by doubling."""
    now = cut(parents)
    while True:
        up = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        after = cut(now.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
        now = after.select("a", "b")
        if after.where("moved").limit(1).count() == 0:
            return now.select("a", F.col("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (a, root): large and small stars in turn until nothing moves.  Every end but the roots has a row."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # now every a has only earlier neighbours: tie them and a to the earliest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        # at the end all edges are stars: no a has two roots and no root is an a
        loose = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() + after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        now = after
        if loose == 0:
            return now.select("a", F.col("b").alias("root"))


def _rest(large: DataFrame, tops: DataFrame, sigs: DataFrame, members: DataFrame, docs: DataFrame, percent: int, least: float) -> DataFrame | None:
    """(top, end): what the tops of dense regions, (cid, key), come under by the links that no window has shown."""
    left = _unsettled(large, tops)
    if left.isEmpty():
        return None
    # repeated rows of a document bring its set again
    sets = cut(_sets(left, members, docs).dropDuplicates(["cid"]))
    if left.limit(WHOLE + 1).count() <= WHOLE:
        groups = sets.select("cid", F.floor(F.length("hashes") / 8).alias("size"), F.lit(0).cast("long").alias("group"))
    else:
        groups = _groups(_prefixes(sets, percent))
    known = cut(sigs.join(left, "cid").join(tops.select("cid", F.col("top").alias("root")), "cid"))
    open_ = cut(_open(_tiles(groups, percent).join(known, "cid"), least, spread=True))
    links = _similar_in_buckets(open_.join(sets, "cid"), percent, np.uint64, 0, spread=True)
    for end in ("a", "b"):
        links = links.join(known.select(F.col("cid").alias(end), F.col("root").alias(f"top_{end}")), end)
    return components(links.select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))).select(F.col("a").alias("top"), F.col("root").alias("end"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", text_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``; with ``text_hash`` also the 64-bit hash of its text,
    which tells rows of one doc_id apart."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    signed = cut(signatures(docs, doc_id, text))
    named = signed.where(F.col("cid").isNotNull() & F.col("doc_id").isNotNull())
    members = cut(named.groupBy("cid").agg(F.min("doc_id").alias("doc_id")))
    # one row for each class; repeated rows would only repeat candidates
    classes = named.join(members, ["cid", "doc_id"]).select("cid", "sig", "keys")
    share = percent / 100
    deviation = (SLOTS * share * (1 - share)) ** 0.5
    least = SLOTS * share - 4 * deviation
    buckets, large = _buckets(classes)
    buckets = cut(buckets)

    best = _closest(buckets, least)
    first = cut(best.groupBy("a").agg(F.max(F.struct("same", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
    roots = _roots(_confirmed(first, members, source, percent))
    rooted = buckets.join(roots.withColumnRenamed("a", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    open_ = cut(_open(rooted, least))
    short = _sets(open_.select("cid"), members, source, short=True)
    rest = cut(_similar_in_buckets(open_.join(short, "cid"), percent))
    links = _confirmed(rest, members, source, percent)
    under = roots.select(F.col("a").alias("x"), "root")
    links = links.join(under, links.a == under.x, "left").select(F.coalesce("root", "a").alias("a"), "b")
    links = links.join(under, links.b == under.x, "left").select("a", F.coalesce("root", "b").alias("b"))
    tops = components(links).select(F.col("a").alias("root"), F.col("root").alias("top"))
    of = members.join(roots.withColumnRenamed("a", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    of = of.join(tops, "root", "left").select("cid", "doc_id", F.coalesce("top", "root").alias("top"))
    if large is not None:
        of = cut(of)
        ends = _rest(large, of, classes.select("cid", "sig"), members, source, percent, least - 2 * deviation)
        if ends is not None:
            of = of.join(small_side(ends), "top", "left").select("cid", "doc_id", F.coalesce("end", "top").alias("top"))
    lowest = of.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    of = cut(of.join(lowest, "top").select("cid", "component_id"))
    out = signed.select("doc_id", "n_shingles", "cid", "text_hash").join(of, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["text_hash"] if text_hash else []))
