"""A hierarchical Pitman-Yor language model over words, learnt from the corpus and used to score it.

Restaurants in three levels: one for each class of the word before (``CLASSES`` classes, named by the ending of that word
and some bits of its hash), which share parents by that ending (``CLASSES >> LOW`` of them), which share the unigram
restaurant; below it stands the uniform distribution over the known words and one unknown word.  Customers are seated by a
blocked Gibbs sampler: a sweep seats the customers of one dish in one restaurant anew, one after another as the Chinese
restaurant process has it, given all the others; a table opened is a customer of the parent.  Where ``FINE`` times so many
sit already, a step seats more than one: the tables that they open are drawn together, at the chance of the one in their
middle, which is within 1 / ``FINE``² of their mean.  Probabilities are averaged over the last ``KEPT`` of ``SWEEPS`` sweeps.

Layout.  Everything about a word is in one bucket, chosen by the word's hash, so seating needs no exchange but the totals of
each restaurant: arrays of a fixed size that the driver sums after a sweep and sends back.  Tables of words and counts never
leave their buckets.  Tokens are sent once to the bucket of their word to be scored, as arrays of a few bytes a token; what
comes back is one partial sum per document and bucket.  A bucket of very frequent words has as many copies as its tokens
need to be about as many as another's; each copy seats the same tables and scores a share of the tokens.  Bursts of random numbers are seeded by bucket and sweep, so a task
that is run again after a lost executor gives the same seating.

Words are A-Z lower-cased runs of anything but ASCII white space, named by 64 bits of hash.  Defined results: a null or
empty text is its end token alone; a null doc_id counts as the text '' where documents are held out; repeated rows are
scored (and learnt) each; with nothing to learn from, the uniform distribution over one unknown word stands; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

CLASSES, LOW = 1 << 18, 8
PARENTS = CLASSES >> LOW
SWEEPS, KEPT = 3, 2

#: Strengths of the restaurants of a class, of an ending and of the unigram.  Discounts are set from the data.
STRENGTH = (1.0, 1.0, 1.0)

#: Customers for each one that a step may seat at once.
FINE = 64

#: Characters of text for each bucket, tokens of a batch that a task sends at once.
BUCKET_CHARS, BATCH = 20_000_000, 800_000

#: Arrays of totals that one task adds, and that the driver does.
FAN_IN, FEW = 16, 8

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x100000001B3
_END = np.uint64(0x1D8E4E27C47D124F)
_BEGIN_CLASS = np.uint32(0)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class _Words:
    """Words of a text as 64-bit hashes, and the class that each makes for the word after it."""

    def __init__(self):
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power, self.inverse = (np.cumprod(np.full(n + 1, p, np.uint64), dtype=np.uint64) for p in (_P, pow(_P, -1, 1 << 64)))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        if len(data) + 1 > len(self.power):
            self._grow(2 * len(data))
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            return np.array([_END]), np.array([_BEGIN_CLASS])
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)))
            word = _mix((total[stop] - total[start]) * self.inverse[start] + (stop - start).astype(np.uint64))
            tail = np.zeros(len(word), np.uint64)
            for k in (1, 2, 3):
                tail = tail * np.uint64(257) + np.where(stop - k >= start, data[np.maximum(stop - k, 0)], 0).astype(np.uint64)
            ending = _mix(tail + np.uint64(1)) % np.uint64(PARENTS - 1) + np.uint64(1)  # ending 0 is the text's beginning
        name = ((ending << np.uint64(LOW)) | (word >> np.uint64(64 - LOW))).astype(np.uint32)
        return np.append(word, _END), np.concatenate(([_BEGIN_CLASS], name))


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash, so that words sorted by hash are sorted by bucket."""
    return ((word >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths in one compressed blob."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = b"".join(a.tobytes() for a in arrays)
    raw = len(head).to_bytes(4, "little") + head + body
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for spec in raw[4 : 4 + n].decode().split(";"):
        kind, _, size = spec.partition(",")
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += kind.itemsize * int(size)
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


_SCHEMA = "r int, kind int, batch long, blob binary"


def _row(r: int, kind: int, batch: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([kind], pa.int32()), pa.array([batch], pa.int64()), pa.array([blob], pa.binary())], ["r", "kind", "batch", "blob"])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (doc_id, held, t): doc_ids, held, words, classes and documents (by place) of about BATCH tokens."""
    words = _Words()
    ids, held, w, c, n, size = [], [], [], [], [], 0

    def flush():
        return ids, held, np.concatenate(w), np.concatenate(c), np.repeat(np.arange(len(n), dtype=np.uint16), n)

    for batch in batches:
        for doc_id, out, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            a, b = words(text.as_py())
            ids.append(doc_id.as_py())
            held.append(out.as_py())
            w.append(a)
            c.append(b)
            n.append(len(a))
            size += len(a)
            if len(n) == 60_000 or size >= BATCH:
                yield flush()
                ids, held, w, c, n, size = [], [], [], [], [], 0
    if n:
        yield flush()


def _count_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts of (word, class) in the documents that are learnt from, added up per task before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, word, name, _ in _batches(batches):
            order = np.lexsort((name, word))
            word, name = word[order], name[order]
            first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (name[1:] != name[:-1]))))
            count = np.diff(np.append(first, len(word))).astype(np.uint32)
            word, name = word[first], name[first]
            edges = np.searchsorted(_bucket(word, buckets), np.arange(buckets + 1))
            for r in range(buckets):
                a, b = edges[r], edges[r + 1]
                if b > a:
                    starts = _runs(word[a:b])
                    yield _row(r, 0, 0, _pack(word[a:b][starts], np.diff(np.append(starts, b - a)).astype(np.uint32), name[a:b], count[a:b]))

    return docs.where(~F.col("held")).mapInArrow(lean(run), _SCHEMA)


def _by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartitionById(buckets, F.col("r")).sortWithinPartitions("r", "kind", "batch")


def _state(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its words, how many classes each has, the classes and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(r: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            word = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            name = np.concatenate([p[2] for p in parts])
            count = np.concatenate([p[3] for p in parts])
            known, at = np.unique(word, return_inverse=True)
            key = at.astype(np.int64) * CLASSES + name
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = _runs(key)
            count = np.add.reduceat(count[order].astype(np.int64), first)
            key = key[first]
            return _row(r, 0, 0, _pack(known, np.bincount(key // CLASSES, minlength=len(known)).astype(np.uint32), (key % CLASSES).astype(np.uint32), count.astype(np.uint32)))

        now, parts = None, []
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if r != now and parts:
                    yield close(now, parts)
                    parts = []
                now = r
                parts.append(_unpack(blob.as_py()))
        if parts:
            yield close(now, parts)

    return _by_bucket(rows, buckets).mapInArrow(lean(run), _SCHEMA)


class Totals:
    """What all buckets share: customers and tables of every restaurant after a sweep."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, parent_customers: np.ndarray, parent_tables: np.ndarray, scalars: np.ndarray):
        self.arrays = [customers, tables, parent_customers, parent_tables, scalars]

    customers = property(lambda self: self.arrays[0])
    tables = property(lambda self: self.arrays[1])
    parent_customers = property(lambda self: self.arrays[2])
    parent_tables = property(lambda self: self.arrays[3])
    #: customers and tables of the unigram, known words, tokens, pairs seen once, pairs seen twice
    scalars = property(lambda self: self.arrays[4])


class Seating:
    """The tables of one bucket's words in the three levels, as they stand after a sweep."""

    def __init__(self, blob: bytes, r: int):
        self.r = r
        self.word, per_word, self.name, self.count = _unpack(blob)
        at = np.repeat(np.arange(len(self.word), dtype=np.int64), per_word)
        self.starts = np.concatenate(([0], np.cumsum(per_word, dtype=np.int64)))[:-1]
        self.key = at * CLASSES + self.name
        # classes of a word are sorted, so those of one parent stand together
        parent_key = at * PARENTS + (self.name >> LOW)
        self.parent_first = _runs(parent_key)
        self.parent_key = parent_key[self.parent_first]
        self.parent_of = np.cumsum(np.concatenate(([0], parent_key[1:] != parent_key[:-1])), dtype=np.int32) if len(parent_key) else np.zeros(0, np.int32)
        self.parent_name = self.parent_key % PARENTS
        self.parent_at = self.parent_key // PARENTS
        self.word_first = _runs(self.parent_at)
        self.tables = np.ones(len(self.key), np.int32)
        self._gather()
        self.parent_tables = np.ones(len(self.parent_key), np.int32)
        self._gather_parents()
        self.word_tables = np.ones(len(self.word), np.int32)

    def _gather(self) -> None:
        self.parent_count = np.add.reduceat(self.tables, self.parent_first, dtype=np.int64) if len(self.key) else np.zeros(0, np.int64)

    def _gather_parents(self) -> None:
        self.word_count = np.add.reduceat(self.parent_tables, self.word_first, dtype=np.int64) if len(self.parent_key) else np.zeros(0, np.int64)

    def totals(self) -> Totals:
        def by(names: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            return np.bincount(names, weights=values, minlength=n).astype(np.int64)

        scalars = [self.word_count.sum(), self.word_tables.sum(), len(self.word), self.count.sum(dtype=np.int64), (self.count == 1).sum(), (self.count == 2).sum()]
        return Totals(
            by(self.name, self.count, CLASSES), by(self.name, self.tables, CLASSES), by(self.parent_name, self.parent_count, PARENTS), by(self.parent_name, self.parent_tables, PARENTS), np.array(scalars, np.int64)
        )

    # probabilities, given the totals t and the discounts d of class, ending and unigram

    def unigram(self, t: Totals, d: tuple[float, ...], at: np.ndarray | None = None) -> np.ndarray | float:
        """Of the known words at ``at``; of an unknown word if that is None."""
        full = STRENGTH[2] + t.scalars[0]
        base = (STRENGTH[2] + d[2] * t.scalars[1]) / full / (t.scalars[2] + 1)
        return base if at is None else (self.word_count[at] - d[2] * self.word_tables[at]) / full + base

    def _mass(self, t: Totals, d: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        full, parent_full = STRENGTH[0] + t.customers, STRENGTH[1] + t.parent_customers
        return full, (STRENGTH[0] + d[0] * t.tables) / full, parent_full, (STRENGTH[1] + d[1] * t.parent_tables) / parent_full

    def parent(self, t: Totals, d: tuple[float, ...]) -> np.ndarray:
        """Of each (ending, word) that has a restaurant's dish."""
        _, _, full, mass = self._mass(t, d)
        return (self.parent_count - d[1] * self.parent_tables) / full[self.parent_name] + mass[self.parent_name] * self.unigram(t, d, self.parent_at)

    def sweep(self, t: Totals, d: tuple[float, ...], number: int) -> None:
        rng = np.random.Generator(np.random.PCG64([20240501, self.r, number]))
        below = self.parent(t, d)[self.parent_of] if len(self.key) else np.zeros(0)
        self.tables = _seat(self.count, (STRENGTH[0] + d[0] * t.tables[self.name]) * below, d[0], rng)
        self._gather()
        below = self.unigram(t, d, self.parent_at)
        self.parent_tables = _seat(self.parent_count, (STRENGTH[1] + d[1] * t.parent_tables[self.parent_name]) * below, d[1], rng)
        self._gather_parents()
        alone = (STRENGTH[2] + d[2] * t.scalars[1]) / (t.scalars[2] + 1)
        self.word_tables = _seat(self.word_count, np.full(len(self.word), alone), d[2], rng)

    def find(self, word: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words, of their pairs with the class and with its ending; -1 where there is none."""

        def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(wanted), -1, np.int64)
            i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[i] == wanted, i, -1)

        at = place(self.word, word)
        known = np.flatnonzero(at >= 0)
        pair, parent = np.full(len(word), -1, np.int64), np.full(len(word), -1, np.int64)
        pair[known] = place(self.key, at[known] * CLASSES + name[known])
        parent[known] = place(self.parent_key, at[known] * PARENTS + (name[known] >> LOW))
        return at, pair, parent

    def probability(self, t: Totals, d: tuple[float, ...], found: tuple[np.ndarray, np.ndarray, np.ndarray], name: np.ndarray) -> np.ndarray:
        at, pair, parent = found
        full, mass, parent_full, parent_mass = self._mass(t, d)
        p = np.full(len(at), self.unigram(t, d))
        known = np.flatnonzero(at >= 0)
        p[known] = self.unigram(t, d, at[known])
        p *= parent_mass[name >> LOW]
        has = np.flatnonzero(parent >= 0)
        i = parent[has]
        p[has] += (self.parent_count[i] - d[1] * self.parent_tables[i]) / parent_full[self.parent_name[i]]
        p *= mass[name]
        has = np.flatnonzero(pair >= 0)
        i = pair[has]
        p[has] += (self.count[i] - d[0] * self.tables[i]) / full[self.name[i]]
        return p


def _seat(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that ``count`` customers of each dish take; ``weight``: strength times the parent's probability of the dish."""
    tables = np.ones(len(count), np.int32)
    active = np.flatnonzero(count > 1)
    seated = 1
    while len(active):
        step = max(1, seated // FINE)
        many = np.minimum(step, count[active] - seated)
        w = weight[active]
        chance = w / (w + seated + (many - 1) / 2 - discount * tables[active])
        tables[active] += (rng.random(len(active)) < chance) if step == 1 else rng.binomial(many, chance)
        seated += step
        active = active[count[active] > seated]
    return tables


def _added(rows: DataFrame) -> DataFrame:
    """The sums of the packed arrays of each r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                own = _unpack(blob.as_py())
                sums[r] = own if r not in sums else [a + b for a, b in zip(sums[r], own, strict=True)]
        for r, own in sums.items():
            yield _row(r, 0, 0, _pack(*own))

    return rows.mapInArrow(lean(run), _SCHEMA)


def _summed(state: DataFrame, buckets: int, history: list[Totals], discounts: tuple[float, ...]) -> Totals | None:
    """Totals over all buckets after as many sweeps as ``history`` has, added up as a tree; ``FEW`` of its nodes reach the driver."""
    shared = state.sparkSession.sparkContext.broadcast([h.arrays for h in history])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [Totals(*a) for a in shared.value]
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                seating = Seating(blob.as_py(), r)
                for i, t in enumerate(before):
                    seating.sweep(t, discounts, i)
                yield _row(r, 0, 0, _pack(*seating.totals().arrays))

    rows, n = state.mapInArrow(lean(run), _SCHEMA), buckets
    while n > FEW:
        n = max(FEW, -(-n // FAN_IN))
        rows = _added(rows.withColumn("r", F.col("r") % n).repartition(n, "r"))
    parts = [_unpack(bytes(r.blob)) for r in rows.select("blob").collect()]
    return Totals(*(sum(x) for x in zip(*parts, strict=True))) if parts else None


def _nothing() -> Totals:
    z = np.zeros(CLASSES, np.int64)
    return Totals(z, z, np.zeros(PARENTS, np.int64), np.zeros(PARENTS, np.int64), np.zeros(6, np.int64))


def _copies(state: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """Of each bucket the number of its first copy and how many there are: one for each mean bucket's tokens that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [int(_unpack(blob.as_py())[3].sum(dtype=np.int64)) for blob in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["r", "n"])

    sizes = [0] * buckets
    for r in state.mapInArrow(lean(run), "r int, n long").collect():
        sizes[r["r"]] = r["n"]
    mean = max(1, sum(sizes) // buckets)
    many = [max(1, round(n / mean)) for n in sizes]
    return [sum(many[:r]) for r in range(buckets)], many


def _token_rows(docs: DataFrame, buckets: int, first: list[int], many: list[int]) -> DataFrame:
    """Kind 1: a batch's tokens of one bucket, for one of its copies.  Kind 2: the batch's documents, dealt over all."""
    places = sum(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids, held, word, name, doc) in enumerate(_batches(batches)):
            batch = (TaskContext.get().partitionId() << 32) | number
            n = np.bincount(doc, minlength=len(ids)).astype(np.uint32)
            missing = np.array([i is None for i in ids])
            yield _row(batch % places, 2, batch, _pack(np.array([i or 0 for i in ids], np.int64), missing, np.array(held, bool), n))
            order = np.argsort(word, kind="stable")
            word, name, doc = word[order], name[order], doc[order]
            edges = np.searchsorted(_bucket(word, buckets), np.arange(buckets + 1))
            for r in range(buckets):
                a, b = edges[r], edges[r + 1]
                if b > a:
                    starts = _runs(word[a:b])
                    place = first[r] + (number + (batch >> 32)) % many[r]
                    yield _row(place, 1, batch, _pack(word[a:b][starts], np.diff(np.append(starts, b - a)).astype(np.uint32), name[a:b], doc[a:b]))

    return docs.mapInArrow(lean(run), _SCHEMA)


def score(docs: DataFrame, held: Column | None = None, doc_id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, kept: int = KEPT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row; scores are log10.

    ``doc_id`` must be a whole number.  Documents for which ``held`` is true are not learnt from."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (held if held is not None else held_out(F.col(doc_id))).alias("held"), F.col(text).alias("t"))
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first().n
    buckets = max(6, -(-int(chars) // BUCKET_CHARS))
    state = cut(_state(_count_rows(source, buckets), buckets))
    start = _summed(state, buckets, [], (0.5, 0.5, 0.5)) or _nothing()
    once, twice = (int(x) for x in start.scalars[4:6])
    # the usual estimate of the discount from what is seen once and twice
    d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    discounts = (d, d, d)
    history = [start]
    for _ in range(sweeps):
        history.append(_summed(state, buckets, history, discounts) or start)
    train_tokens, known_words = int(start.scalars[3]), int(start.scalars[2])
    shared = docs.sparkSession.sparkContext.broadcast([h.arrays for h in history])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [Totals(*a) for a in shared.value]
        now, samples, seating = None, [], None
        for arrow in batches:
            for r, kind, batch, blob in zip(*(arrow.column(i).to_pylist() for i in range(3)), arrow.column(3), strict=True):
                if kind == 2:
                    yield _row(0, 2, batch, blob.as_py())
                    continue
                if r != now or kind == 0:  # a bucket's seating comes before its tokens, if it has one
                    now, samples = r, []
                    # a copy seats as its bucket does, whose number stands in the place of the batch's
                    seating = Seating(blob.as_py() if kind == 0 else _pack(np.zeros(0, np.uint64), *[np.zeros(0, np.uint32)] * 3), batch if kind == 0 else r)
                    for i in range(sweeps):
                        seating.sweep(totals[i], discounts, i)
                        if i >= sweeps - kept:
                            samples.append((totals[i + 1], seating.tables, seating.parent_count, seating.parent_tables, seating.word_count, seating.word_tables))
                    if kind == 0:
                        counts = np.add.reduceat(seating.count, seating.starts, dtype=np.int64) if len(seating.word) else np.zeros(0, np.int64)
                        continue
                    counts = np.zeros(0, np.int64)
                words, times, name, doc = _unpack(blob.as_py())
                word = np.repeat(words, times)
                found = seating.find(word, name)
                p = np.zeros(len(word))
                for t, seating.tables, seating.parent_count, seating.parent_tables, seating.word_count, seating.word_tables in samples:
                    p += seating.probability(t, discounts, found, name)
                at = found[0]
                seen = np.zeros(len(word))
                seen[at >= 0] = counts[at[at >= 0]]
                which, back = np.unique(doc, return_inverse=True)
                sums = [np.bincount(back, weights=x) for x in (np.log10(p / len(samples)), np.log10(seen + 1))]
                yield _row(0, 1, batch, _pack(which, sums[0], sums[1], np.bincount(back, weights=seen > 0).astype(np.uint32)))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(table: list[np.ndarray], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            ids, missing, out, n = table
            sums = [np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))]
            for which, *values in parts:
                for s, v in zip(sums, values, strict=True):
                    s[which] += v
            base = sums[1] - n * np.log10(train_tokens + known_words + 1)
            cols = [pa.array(ids, pa.int64(), mask=missing), pa.array(out), pa.array(n.astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(ids), train_tokens))]
            cols += [pa.array(base), pa.array(sums[0]), pa.array(10 ** np.minimum(-sums[0] / np.maximum(n, 1), 300))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        now, table, parts = None, None, []
        for arrow in batches:
            for kind, batch, blob in zip(arrow.column(1).to_pylist(), arrow.column(2).to_pylist(), arrow.column(3), strict=True):
                if batch != now:
                    if table is not None:
                        yield close(table, parts)
                    now, table, parts = batch, None, []
                if kind == 2:
                    table = _unpack(blob.as_py())
                else:
                    parts.append(_unpack(blob.as_py()))
        if table is not None:
            yield close(table, parts)

    first, many = _copies(state, buckets)
    table = docs.sparkSession.createDataFrame(list(enumerate(zip(first, many, strict=True))), "r int, c struct<first:int,many:int>")
    copies = state.join(F.broadcast(table), "r").select(F.explode(F.sequence(F.col("c.first"), F.col("c.first") + F.col("c.many") - 1)).alias("r"), "kind", F.col("r").cast("long").alias("batch"), "blob")
    places = sum(many)
    dealt = copies.unionByName(_token_rows(source, buckets, first, many)).repartitionById(places, F.col("r")).sortWithinPartitions("r", "kind", "batch")
    scored = dealt.mapInArrow(lean(run), _SCHEMA)
    return (
        scored.repartition("batch")
        .sortWithinPartitions("batch", "kind")
        .mapInArrow(lean(combine), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    )
