"""Best-fit packing after Martello-Toth dominance reduction.

Documents are told apart by their length only, so an instance of any number of documents is a histogram of at most
``capacity`` counts.  That histogram, of bounded size, is solved on the driver: sets of documents that provably dominate
every other set with the same longest document are fixed for good, which shrinks the instance; best fit decreasing packs
what is left.  The solution is a table of runs (length, ranks, sequence, offset); each piece finds its place in it by
its rank among the pieces of its length, so no task sees more than one share of a length's pieces.

Defined results: a null or empty text is its end token alone.  A document longer than a sequence is cut into pieces of
the capacity, the last one shorter.  Repeated rows are packed each.  Equal lengths are interchangeable; ranks follow
doc_id and piece.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, lean

CAPACITY = 2048

#: Rows of one length that are ranked in one task, about; a length's rows are split into as many shares as that takes.
SHARE, SHARES_MOST = 100_000, 4096

#: Distinct chunks of text whose ids a worker remembers, and how many of them stay when there is no more room: those that
#: were met first, which are the frequent ones.
CACHE, CACHE_KEEPS = 450_000, 300_000

#: Longer chunks are encoded each time they come.
CACHE_CHARS = 256

#: Characters of the remembered chunks together, and how many of them stay when there is no more room, so what a worker
#: remembers is bounded in bytes too.
CACHE_TEXT, CACHE_TEXT_KEEPS = 12_000_000, 8_000_000

#: Characters of the texts whose chunks are held at once; a longer text is encoded alone.
TEXTS = 1_000_000

# In texts of these characters only, the tokenizer's normal form is the lower case, and its words never cross a space.
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u024f]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\u024f]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, from remembered chunks where the text allows it.

    New chunks are encoded together.  Every word of this kind of vocabulary ends with a token that says so, which tells
    where the ids of one chunk end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of what is remembered
        self.passing: list[str] = []

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _forget(self) -> None:
        if len(self.known) <= CACHE and self.held <= CACHE_TEXT:
            return
        sums = list(itertools.accumulate(map(len, itertools.islice(self.known, CACHE_KEEPS))))
        keeps = bisect.bisect_right(sums, CACHE_TEXT_KEEPS)
        for c in list(itertools.islice(self.known, keeps, None)):
            del self.known[c]
        self.held = sums[keeps - 1] if keeps else 0

    def _learn(self, chunks: set[str]) -> None:
        for c in self.passing:
            del self.known[c]
        self._forget()
        new = [c for c in chunks if c not in self.known]
        self.passing = [c for c in new if len(c) > CACHE_CHARS]
        self.held += sum(map(len, new)) - sum(map(len, self.passing))
        if not new:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        words = np.cumsum([len(_PLAIN_WORDS.findall(c)) for c in new])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != words[-1]:
            self.known.update((c, self._slow(c)) for c in new)
            return
        stops = (4 * ends[words - 1]).tolist()
        data = ids.tobytes()
        at = 0
        for c, stop in zip(new, stops, strict=True):
            self.known[c] = data[at:stop]
            at = stop

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        some: list[str] = []
        held = 0
        for t in texts:
            if some and held + len(t) > TEXTS:
                yield from self._encode(some)
                some, held = [], 0
            some.append(t)
            held += len(t)
        yield from self._encode(some)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        parts = [None if _NOT_PLAIN.search(t) or "<|" in t else t.lower().split() for t in texts]
        self._learn(set().union(*(p for p in parts if p is not None)))
        for t, p in zip(texts, parts, strict=True):
            yield self._slow(t) if p is None else b"".join(map(self.known.__getitem__, p))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker process's own, kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    path = tokenizer or default_tokenizer()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.zeros(1, "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), step)):
                        own = ids[a : a + step]
                        row.append(i)
                        piece.append(k)
                        start.append(k * capacity)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Bins = tuple[int, list[tuple[int, int]]]  # so many sequences, each of runs (length, how often)


def reduce_instance(count: np.ndarray, capacity: int) -> list[Bins]:
    """Fixes dominating sets and takes them out of ``count`` (by length): what it returns is part of an optimal packing.

    A feasible set F with the longest document j dominates a feasible set F' with j if the others of F' can be parted into
    groups of which each fits in the place of another document of F.  F is fixed if it dominates every F'.
    """
    fixed: list[Bins] = []

    def fix(lengths: list[int], n: int) -> None:
        runs: list[tuple[int, int]] = []
        for v in lengths:
            count[v] -= n
            if runs and runs[-1][0] == v:
                runs[-1] = (v, runs[-1][1] + 1)
            else:
                runs.append((v, 1))
        fixed.append((n, runs))

    def largest(most: int, used: dict[int, int]) -> int:
        """The longest length up to ``most`` of which a document is left over; 0 if none."""
        for v in np.flatnonzero(count[: most + 1])[::-1]:
            if count[v] > used.get(int(v), 0):
                return int(v)
        return 0

    def smallest(k: int, j: int) -> list[int]:
        out: list[int] = []
        for v in np.flatnonzero(count):
            out += [int(v)] * int(min(k, count[v] - (v == j)))
            if len(out) >= k:
                break
        return out[:k]

    def times(lengths: list[int]) -> int:
        return min(int(count[v]) // lengths.count(v) for v in lengths)

    for j in range(capacity, 0, -1):
        while count[j] > 0:
            room = capacity - j
            few = smallest(3, j)
            if not few or few[0] > room:  # nothing fits beside it
                fix([j], int(count[j]))
                continue
            a = largest(room, {j: 1})
            # one document fills the room, or no two fit: the longest that fits is as good as any set
            if a == room or len(few) < 2 or few[0] + few[1] > room:
                fix([j, a], times([j, a]))
                continue
            if len(few) < 3 or sum(few) > room:  # two at most fit
                b = largest(room - a, {j: 1} | {a: 2 if a == j else 1})
                if b and not _escapes(count, room, a, b):
                    fix([j, a, b], times([j, a, b]))
                    continue
            break
    return fixed


def _escapes(count: np.ndarray, room: int, a: int, b: int) -> bool:
    """Whether some two documents fit in the room that neither lie under (a, b) one by one nor fit together under a."""
    have = np.flatnonzero(count[: room + 1])
    for y in have[have > b]:
        if 2 * y > room:
            break
        x = have[have <= room - y][-1]
        if x >= y and x + y > a:
            return True
    return False


def best_fit(count: np.ndarray, capacity: int) -> list[Bins]:
    """Best fit decreasing over a histogram.  Sequences that hold the same are one entry with a number."""
    open_: dict[int, list[Bins]] = {}
    rooms: list[int] = []  # keys of open_, sorted

    def put(room: int, n: int, runs: list[tuple[int, int]]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((n, runs))

    for v in range(capacity, 0, -1):
        left = int(count[v])
        while left:
            at = bisect.bisect_left(rooms, v)
            if at < len(rooms):
                room = rooms[at]
                n, runs = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, runs = capacity, []
                n = -(-left // (capacity // v))
            k = room // v  # best fit puts the next one of this length in the same sequence until it is full
            full = min(n, left // k)
            if full:
                put(room - k * v, full, [*runs, (v, k)])
            left -= full * k
            rest = n - full
            if rest and left:
                put(room - left * v, 1, [*runs, (v, left)])
                left, rest = 0, rest - 1
            if rest and runs:
                put(room, rest, runs)
    return [b for room in rooms for b in open_[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, how often in a sequence, first sequence, offset), sorted by length and rank."""
    count = np.zeros(capacity + 1, np.int64)
    for v, n in histogram.items():
        count[v] = n
    found = reduce_instance(count, capacity)
    found += best_fit(count, capacity)
    rank, sequence, rows = [0] * (capacity + 1), 0, []
    for n, runs in found:
        offset = 0
        for v, k in runs:
            rows.append((v, rank[v], k, sequence, offset))
            rank[v] += n * k
            offset += v * k
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with a column length, 1 to capacity) with sequence_id and offset."""
    sized = cut(cut_pieces)
    # at most ``capacity`` rows come to the driver
    histogram = {r.length: r.n for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    solved = plan(histogram, capacity)
    shares = int(min(SHARES_MOST, max(16, sum(histogram.values()) // SHARE)))
    sized = sized.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    by_share = sized.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    base = by_share.select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    if len(histogram) * shares <= BROADCAST_ROWS:
        base = F.broadcast(base)
    ranked = sized.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece")))
    ranked = ranked.join(base, ["length", "_share"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).drop("_share", "_base")
    names = [c for c in cut_pieces.columns]
    ranked = ranked.select(*names, "_rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id long, offset long"
    at_length = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for (length, first rank)
        key = solved[:, 0] * (1 << 48) + solved[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i), np.int64) for i in (at_length, len(names)))
            run = solved[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            within = rank - run[:, 1]
            sequence, offset = run[:, 3] + within // run[:, 2], run[:, 4] + within % run[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), schema)
