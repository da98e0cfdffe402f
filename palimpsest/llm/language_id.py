"""Language identification by interpolated Kneser-Ney character models, one per language.

The models live in sorted arrays of hashed n-grams with a column of log-probabilities per language; the chosen language is
the one of the lowest cross-entropy per character.  A text is rejected if even that cross-entropy is above what all but a
share of ``FALSE_REJECT`` of pieces of its length and language have, in documents that the models were not fitted on: beyond
the ``TAIL`` highest of those pieces their exceedances are continued as an exponential tail.  For this each ``WINDOW`` of
a text is taken in its own best language, and of the windows the ``MAIN_PART`` that fits best, so a text that changes from
one known language to another, or quotes an unknown one, is not rejected.

Fitting reads a bounded sample of labelled rows: of the ``LANGUAGES`` most frequent labels ``SAMPLE`` different texts each,
those of the lowest hash, as far as they have ``CHARS`` characters together, the first one whole whatever its length.  A text
that is repeated counts once, and a language of one text has a model.  One text in five is kept back for calibration.
Prediction reads whole texts.

Characters are lower-cased; whatever is no letter counts as one space.  Defined results: a null text, or one without a
letter, is ``und`` with score 0 and is rejected; equal cross-entropies go to the smaller language by code point; repeated
rows are judged alike; with no labelled row at all every text is ``und``; an empty table gives an empty result.  Long texts
are scored in blocks, never cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean

ORDER, DISCOUNT = 4, 0.75

#: Labelled texts that are read per language, languages, and characters of all languages together: the bound of the sample.
SAMPLE, LANGUAGES, CHARS = 1500, 64, 24_000_000

#: Lengths at which the bound of each language is calibrated, and pieces of each length that are taken from a document.
BANDS, PIECES = (16, 64, 256, 1024, 4096), 4

#: Texts of a known language that may be rejected, the share of the calibration that tells of the tail, and how many standard
#: errors the mean of so few exceedances is taken higher; and how much wider for one text, less for more, as pieces of one text
#: are alike.
FALSE_REJECT, TAIL, DOUBT, FEW_TEXTS = 1e-4, 0.1, 1.0, 3.0

#: Least mean exceedance that is taken for the tail's, in nats per character at one character; it falls with the root of the
#: length.  Few pieces may happen to lie close together.
LEAST_EXCESS = 0.3

#: Characters of a text that are in one language, as far as rejection goes, and the share of them that is looked at.
WINDOW, MAIN_PART = 64, 2 / 3

#: Sharpness of the score, the share of the best language among exp(-SHARP * cross-entropy).
SHARP = 10.0

#: Characters that are scored at once.
BLOCK = 1 << 18

UNKNOWN = "und"

_SPACE = 32


def _letters() -> np.ndarray:
    """Code point to itself in lower case if it is a letter of the basic plane, else to the space."""
    out = np.full(1 << 16, _SPACE, np.uint64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


def _codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each after one space and with runs of spaces as one; where each text begins; has a letter."""
    joined = "\0".join(texts).encode("utf-32-le", "surrogatepass")
    raw = np.frombuffer(joined, "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    code = table[np.minimum(raw, 0xFFFF)]
    astral = np.flatnonzero(raw > 0xFFFF)
    if len(astral):  # letters beyond the basic plane share one code
        code[astral] = np.where([chr(c).isalpha() for c in raw[astral]], np.uint64(0xFFFF), np.uint64(_SPACE))
    code = np.concatenate((np.array([_SPACE], np.uint64), code))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _SPACE) | (code[:-1] != _SPACE)
    letters = np.concatenate(([0], np.cumsum(code != _SPACE)))
    has = letters[starts + lengths + 1] > letters[starts]
    # the space before a text is the separator's, and stands for spaces that end the text before it
    begin = np.concatenate(([0], np.cumsum(keep)))[starts + 1] - 1
    code = code[keep]
    return (code[:-1] if code[-1] == _SPACE and len(code) > begin[-1] + 1 else code), begin, has


def _grams(code: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each character, packed into 64 bits; a text's first ones reach back into spaces."""
    out = code.copy()
    for k in range(1, n):
        back = np.full(len(code), _SPACE, np.uint64)
        back[k:] = code[: max(0, len(code) - k)]
        for place in range(k):
            at = begin + place
            back[at[at < np.append(begin[1:], len(code))]] = _SPACE
        out |= back << np.uint64(16 * k)
    return out


def _hash(gram: np.ndarray, n: int) -> np.ndarray:
    """A one-to-one mix of 64 bits, so that different n-grams of one order never share a key."""
    with np.errstate(over="ignore"):
        x = gram + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Models:
    """keys[n], value[n]: hashed n-grams and their log-probability by language; ctx[n], gamma[n]: hashed contexts of n
    characters and the logarithm of the weight that they leave to the shorter context."""

    languages: list[str]
    keys: list[np.ndarray]
    value: list[np.ndarray]
    ctx: list[np.ndarray]
    gamma: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray  # usual cross-entropy by band of length and language
    limit: np.ndarray  # the highest that is accepted, likewise

    def _logp(self, gram: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.broadcast_to(self.floor, (len(gram), len(self.languages)))
        own = gram if n == ORDER else gram & np.uint64((1 << (16 * n)) - 1)
        key = _hash(own, n)
        i = np.searchsorted(self.keys[n], key)
        i[i == len(self.keys[n])] = 0
        out = self.value[n][i]
        miss = np.flatnonzero(self.keys[n][i] != key)
        if len(miss):
            rest = self._logp(own[miss], n - 1)
            if n > 1:
                c = _hash(own[miss] >> np.uint64(16), n - 1)
                j = np.searchsorted(self.ctx[n - 1], c)
                j[j == len(self.ctx[n - 1])] = 0
                rest = rest + np.where((self.ctx[n - 1][j] == c)[:, None], self.gamma[n - 1][j], 0.0)
            else:
                rest = rest + self.gamma[0][0]
            out[miss] = rest
        return out

    def bound(self, n: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The limit for texts of n characters in language i, between the bands by log n."""
        at = np.interp(np.log(np.maximum(n, 1)), np.log(BANDS), np.arange(len(BANDS)))
        low = np.minimum(at.astype(np.int64), len(BANDS) - 2)
        part = at - low
        found = np.where(part > 0, (1 - part) * self.limit[low, i] + part * self.limit[low + 1, i], self.limit[low, i])
        # texts below the first band spread more, by the root of their length
        return found + np.maximum(np.sqrt(BANDS[0] / np.maximum(n, 1)) - 1, 0) * (self.limit[0, i] - self.mean[0, i])

    def entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character by text and language; that of its main part, with the best language of each ``WINDOW``;
        characters; has a letter."""
        code, begin, has = _codes(texts, table)
        n = np.diff(np.append(begin, len(code)))
        # where windows begin; a text's first one is where it begins itself
        windows = np.maximum(-(-n // WINDOW), 1)
        first = np.concatenate(([0], np.cumsum(windows)))[:-1]
        start = np.repeat(begin, windows) + WINDOW * (np.arange(windows.sum()) - np.repeat(first, windows))
        total = np.zeros((len(start), len(self.languages)))
        gram = _grams(code, begin, ORDER)
        # one window begins where the one before it ends, so sums between the beginnings are the windows' sums
        for a in range(0, len(code), BLOCK):
            logp = self._logp(gram[a : a + BLOCK], ORDER)
            low = np.searchsorted(start, a, side="right") - 1
            high = np.searchsorted(start, a + len(logp), side="left")
            edges = np.maximum(start[low:high] - a, 0)
            total[low:high] += np.add.reduceat(logp, edges, axis=0, dtype=np.float64)
        best, size = -total.max(axis=1), np.maximum(np.minimum(WINDOW, np.repeat(begin + n, windows) - start), 1)
        # the windows of each text, the plainest first, and of them those that count
        order = np.lexsort((best / size, np.repeat(np.arange(len(n)), windows)))
        counts = np.arange(len(start)) - np.repeat(first, windows) < np.repeat(np.ceil(windows * MAIN_PART), windows)
        own, chars = (np.add.reduceat(np.where(counts, x[order], 0), first) for x in (best, size))
        return -np.add.reduceat(total, first, axis=0) / np.maximum(n, 1)[:, None], own / chars, n, has


def _split(texts: list[str], chars: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters, with the place of their first one."""
    at, size, out = 0, 0, []
    for i, t in enumerate(texts):
        out.append(t)
        size += len(t) + 1
        if size >= chars:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def _count(sample: DataFrame) -> list:
    """(lang, gram, n) over the sample; as many rows as the bounded sample has distinct 4-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _letters()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, part in _split([t for t, own in zip(texts, langs, strict=True) if own == lang]):
                    code, begin, _ = _codes(part, table)
                    gram, n = np.unique(_grams(code, begin, ORDER), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()


def _kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Models:
    """Interpolated Kneser-Ney of each language from its counts of n-grams of the highest order."""
    grams: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(ORDER + 1)]
    for lang, (g, n) in counts.items():
        grams[ORDER][lang] = (g, n.astype(np.float64))
        for k in range(ORDER - 1, 0, -1):  # continuation counts: before how many characters does it stand
            g, n = np.unique(g & np.uint64((1 << (16 * k)) - 1), return_counts=True)
            grams[k][lang] = (g, n.astype(np.float64))
    keys, value, ctx, gamma = [np.zeros(0, np.uint64)], [np.zeros((0, 0), np.float32)], [np.zeros(0, np.uint64)], []
    alphabet = len(np.unique(np.concatenate([grams[1][x][0] for x in languages]))) + 1
    floor = np.full(len(languages), -np.log(alphabet))
    own: list[np.ndarray] = [np.zeros(0, np.uint64)]
    prob: list[np.ndarray] = []
    weights: list[tuple[np.ndarray, np.ndarray]] = []
    lower = np.exp(floor)
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([grams[k][x][0] for x in languages]))
        contexts = np.unique(union >> np.uint64(16)) if k > 1 else np.zeros(1, np.uint64)
        p, w = np.zeros((len(union), len(languages))), np.ones((len(contexts), len(languages)))
        place = np.searchsorted(contexts, union >> np.uint64(16)) if k > 1 else np.zeros(len(union), np.int64)
        for i, x in enumerate(languages):
            g, n = grams[k][x]
            at = np.searchsorted(union, g)
            total, kinds = np.zeros(len(contexts)), np.zeros(len(contexts))
            np.add.at(total, place[at], n)
            np.add.at(kinds, place[at], 1)
            seen = total > 0
            w[seen, i] = DISCOUNT * kinds[seen] / total[seen]
            p[at, i] = np.maximum(n - DISCOUNT, 0) / total[place[at]]
        if k == 1:
            below = np.broadcast_to(lower, p.shape)
        else:
            below = prob[-1][np.searchsorted(own[-1], union & np.uint64((1 << (16 * (k - 1))) - 1))]
        p += w[place] * below
        own.append(union)
        prob.append(p)
        weights.append((contexts, w))
    for k in range(1, ORDER + 1):
        hashed = _hash(own[k], k)
        order = np.argsort(hashed)
        keys.append(hashed[order])
        value.append(np.log(prob[k - 1])[order].astype(np.float32))
        contexts, w = weights[k - 1]
        if k == 1:
            gamma.append(np.log(w).astype(np.float32))
        else:
            hashed = _hash(contexts, k - 1)
            order = np.argsort(hashed)
            ctx.append(hashed[order])
            gamma.append(np.log(w)[order].astype(np.float32))
    return Models(languages, keys, value, ctx, gamma, floor.astype(np.float32), np.zeros((len(BANDS), len(languages))), np.full((len(BANDS), len(languages)), np.inf))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Models | None:
    """Models of the languages of ``labelled`` (lang, text; other columns are ignored), from a bounded sample."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    hashed = rows.withColumn("_h", F.xxhash64(F.lit("langid"), F.col("text")))
    sizes = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_h").alias("texts"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    # the hash picks about twice the sample first, so that what is ranked is bounded; repeated texts meet as one
    likely = F.lit(False)
    for r in sizes:
        share = min(1.0, 2 * (sample + 50) / max(r["texts"], 1))
        likely = likely | ((F.col("lang") == r["lang"]) & (F.pmod("_h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    different = hashed.where(likely).groupBy("lang", "_h").agg(F.any_value("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("_h", "text")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = different.withColumn("_r", F.row_number().over(order)).withColumn("_before", before)
    ranked = ranked.where((F.col("_r") <= sample) & (F.col("_before") + F.when(F.col("_r") > 1, F.length("text")).otherwise(0) <= CHARS // len(sizes)))
    chosen = cut(ranked.select("lang", "text", "_r"))
    counts: dict[str, tuple[list, list]] = {}
    for r in _count(chosen.where(F.col("_r") % 5 != 0)):
        g, c = counts.setdefault(r["lang"], ([], []))
        g.append(r["gram"])
        c.append(r["n"])
    languages = sorted(counts)
    arrays = {}
    for lang in languages:
        g = np.array(counts[lang][0], np.int64).view(np.uint64)
        order = np.argsort(g)
        arrays[lang] = (g[order], np.array(counts[lang][1], np.int64)[order])
    models = _kneser_ney(arrays, languages)
    held = chosen.where(F.col("_r") % 5 == 0)
    size = F.length("text")
    cuts = [F.when(size >= n * (k + 1) if k else size > n // 2, F.struct(F.lit(band).alias("band"), F.substring("text", n * k + 1, n).alias("piece"))) for band, n in enumerate(BANDS) for k in range(PIECES)]
    pieces = held.select("lang", "_r", F.explode(F.array_compact(F.array(*cuts))).alias("p")).select("lang", "_r", "p.band", "p.piece")
    judged = predict_frame(pieces, models, ["lang", "band", "_r"], "piece").where(F.col("lang") == F.col("lang_pred"))
    # the sample bounds these: PIECES numbers for each band of each text that was kept back
    rows = judged.groupBy("lang", "band").agg(F.sort_array(F.collect_list("entropy")).alias("e"), F.count_distinct("_r").alias("texts")).collect()
    known = {(r["band"], r["lang"]): _tail(np.array(r["e"]), BANDS[r["band"]], r["texts"]) for r in rows}
    for band in range(len(BANDS)):
        own = [v for (b, _), v in known.items() if b == band]
        for i, x in enumerate(languages):
            # a length that calibration lacks takes the bound of the band below, or the widest of the other languages
            widest = max(own, key=lambda v: v[1]) if own else (0.0, np.inf)
            models.mean[band, i], models.limit[band, i] = known.get((band, x)) or ((models.mean[band - 1, i], models.limit[band - 1, i]) if band else widest)
    return models


def _tail(entropies: np.ndarray, length: int, texts: int) -> tuple[float, float]:
    """The mean of sorted cross-entropies of pieces of one length, from so many texts, and the value that a share of ``FALSE_REJECT`` exceeds."""
    top = max(1, int(len(entropies) * TAIL))
    edge = entropies[-top - 1] if len(entropies) > top else entropies[0]
    excess = max(float((entropies[-top:] - edge).mean()), LEAST_EXCESS / math.sqrt(length))
    excess *= 1 + DOUBT / math.sqrt(top) + FEW_TEXTS / max(texts, 1)
    return float(entropies.mean()), float(edge + excess * math.log(TAIL / FALSE_REJECT))


def predict_frame(docs: DataFrame, models: Models | None, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score, entropy and rejected."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(*kept, F.col(text).alias("t"))
    schema = ", ".join([*(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))), "lang_pred string, score double, entropy double, rejected boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, _letters()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(len(keep))
            # the column is read in steps, so no batch of long texts is decoded at once
            for step in range(0, batch.num_rows, 256):
                for at, part in _split([t or "" for t in texts.slice(step, 256).to_pylist()]):
                    if own is None:
                        lang, score, best, bad = [UNKNOWN] * len(part), np.zeros(len(part)), np.full(len(part), np.nan), np.ones(len(part), bool)
                    else:
                        ce, own_best, n, has = own.entropies(part, table)
                        i = ce.argmin(axis=1)
                        score = 1 / np.exp(-SHARP * (ce - ce[np.arange(len(i)), i][:, None])).sum(axis=1)
                        best = own_best
                        bad = ~has | (best > own.bound(n, i))
                        lang = [own.languages[k] if h else UNKNOWN for k, h in zip(i, has, strict=True)]
                        score, best = np.where(has, score, 0.0), np.where(has, best, np.nan)
                    cols = [batch.column(k).slice(step + at, len(part)) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(lang, pa.string()), pa.array(score), pa.array(best), pa.array(bad)], [*(f"k{k}" for k in range(len(keep))), "lang_pred", "score", "entropy", "rejected"]
                    )

    return source.mapInArrow(lean(run), schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "entropy", "rejected")


def held_out(doc_id: Column) -> Column:
    """Documents that the models never learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Fits on the documents that are not held out, then predicts all."""
    models = fit(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return predict_frame(docs, models, keep)
