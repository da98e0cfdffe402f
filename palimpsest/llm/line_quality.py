"""Quality rules, line first: lines are judged by punctuation, navigation and boilerplate rules and removed where they
fail; a document that loses too much of its words by that is rejected.

Words are runs of anything but the six ASCII white-space characters; lines are what stands between ``\\n``; both are
counted over whole texts.

Defined results: a null or empty text has no words, so it fails the base rules.  Repeated rows are judged alike, an empty
table gives an empty result, other columns are carried or ignored as ``keep`` says.  A document is held in memory whole,
one at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

# What a text of so many words, or of so large a repeated part, fails by (the contract's base rules).
LEAST_WORDS, MOST_REPEATED = 50, 50

#: A document is rejected if the lines that stay have less than this percentage of its words.
LEAST_LEFT = 50

SYMBOLS = "#*$%&|<>"

#: Words that part the entries of a menu.
SEPARATORS = ("|", "»", "›", "•", "·")

# Full stops, exclamation and question marks of the scripts that have their own.
#: A line that has none of these is not a sentence.
SENTENCE_MARKS = (".", "!", "?", "…", "。", "｡", "．", "！", "？", "؟", "۔", "।", "॥", "։", "՞", "።", "፧", "။", "។", "᠃", "‼", "⁇", "⁈", "⁉")

#: A line with one of these (A-Z lower-cased) is a notice of a site, not text.
BOILERPLATE = (
    "cookie policy",
    "we use cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "enable javascript",
    "subscribe to our newsletter",
    "click here to",
    "lorem ipsum",
    "back to top",
    "skip to content",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "wir verwenden cookies",
    "nutzungsbedingungen",
    "tous droits réservés",
    "nous utilisons des cookies",
    "politique de confidentialité",
    "conditions d’utilisation",
    "todos los derechos reservados",
    "utilizamos cookies",
    "política de privacidad",
    "términos de uso",
)

#: A line of so many words of which at most a quarter differ is filler.
FILLER_WORDS = 12

_SYMBOLS = SYMBOLS.encode()
_SEPARATORS = tuple(s.encode() for s in SEPARATORS)
_MARKS = tuple(s.encode() for s in SENTENCE_MARKS)
_BOILERPLATE = tuple(s.encode() for s in BOILERPLATE)


def line_failure(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    if not any(m in line for m in _MARKS):
        return "punctuation"
    if line.count(b"!") * 2 > n >= 4 and 2 * sum(w.endswith(b"!") for w in words) > n:
        return "shouting"
    if 2 * (len(line) - len(line.translate(None, _SYMBOLS))) > n:
        seps = sum(words.count(s) for s in _SEPARATORS if s in line)
        return "navigation" if seps >= 2 and 5 * seps >= n else "symbols"
    seps = sum(words.count(s) for s in _SEPARATORS if s in line)
    if seps >= 2 and 5 * seps >= n:
        return "navigation"
    if n >= FILLER_WORDS and 4 * len(set(words)) <= n:
        return "filler"
    low = line.lower()
    if any(b in low for b in _BOILERPLATE):
        return "boilerplate"
    return None


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, cleaned text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words: list[bytes] = []
    seen: set[bytes] = set()
    dup = left = 0
    clean: list[bytes] = []
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            continue
        words += own
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_failure(line, own) is None:
            left += len(own)
            clean.append(line)
    n = len(words)
    chars = sum(map(len, words)) if data.isascii() else len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    counts = Counter(windows)
    if len(counts) < len(windows):
        reach = 0  # the first position that no earlier window has covered
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    return n, chars, symbols, dup, repeated, failed, left, b"\n".join(clean).decode("utf-8", "surrogatepass")


def line_quality(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), cleaned: bool = False) -> DataFrame:
    """``keep`` columns, then the counts, base_failed, left_words, kept (and the cleaned text if asked for)."""
    kept_cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(*kept_cols, F.col(text).alias("t"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_words", "cleaned_text"]
    types = ["long", "long", "long", "long", "long", "boolean", "long", "string"]
    arrow = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.string()]
    n_out = len(names) if cleaned else len(names) - 1
    schema = ", ".join([*(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))), *(f"{a} {b}" for a, b in zip(names[:n_out], types, strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(zip(*(judge(t.as_py())[:n_out] for t in part.column(part.num_columns - 1)), strict=True))
                cols = [part.column(i) for i in range(part.num_columns - 1)] + [pa.array(c, a) for c, a in zip(found, arrow, strict=False)]
                yield pa.RecordBatch.from_arrays(cols, [*(f"k{i}" for i in range(len(cols) - n_out)), *names[:n_out]])

    judged = source.mapInArrow(lean(run), schema)
    verdict = ~F.col("base_failed") & (F.col("left_words") * 100 >= F.col("n_words") * LEAST_LEFT)
    return judged.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names[:n_out], verdict.alias("kept"))
