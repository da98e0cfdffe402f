"""Analyzers of text: words with character bigrams, words with four fields, and Markdown chunks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Token = tuple[str, int]


def normal_chars(text: str) -> tuple[list[str], list[int]]:
    """Compatibility-normalised, lower-cased characters, each code point on its own, and where each comes from."""
    chars: list[str] = []
    source: list[int] = []
    for i, c in enumerate(text):
        if c.isascii():
            chars.append(c.lower())
            source.append(i)
            continue
        for n in unicodedata.normalize("NFKC", c).lower():
            chars.append(n)
            source.append(i)
    return chars, source


def _kind(c: str) -> int:
    """0 for what parts words, 1 for characters of words, 2 for those that are read in pairs."""
    if c.isascii():
        return 1 if c.isalnum() or c == "_" else 0
    return 0 if c.isspace() or unicodedata.category(c)[0] in "PSC" else 2


def tokenize(text: str, index: bool = True) -> list[Token]:
    """(term, position): words at their start; pairs of other characters at each place, and, for an index, the first and
    the last one of a run alone, so that a phrase may begin or end within a pair."""
    chars, _ = normal_chars(text)
    out: list[Token] = []
    i = 0
    while i < len(chars):
        kind = _kind(chars[i])
        j = i + 1
        while j < len(chars) and _kind(chars[j]) == kind:
            j += 1
        if kind == 1:
            out.append(("".join(chars[i:j]), i))
        elif kind == 2:
            if j - i == 1:
                out.append((chars[i], i))
            else:
                if index:
                    out.append((chars[i], i))
                out += [(chars[k] + chars[k + 1], k) for k in range(i, j - 1)]
                if index:
                    out.append((chars[j - 1], j - 1))
        i = j
    return out


def covering(tokens: list[Token]) -> list[Token]:
    """As few of a phrase's tokens as cover all that its tokens cover."""
    ordered = sorted(tokens, key=lambda t: (t[1], -len(t[0])))
    out: list[Token] = []
    reach, i = -1, 0
    while i < len(ordered):
        if ordered[i][1] + len(ordered[i][0]) <= reach:
            i += 1
            continue
        # of those that begin within what is covered, the one that reaches furthest
        start = max(reach, ordered[i][1])
        best = max((t for t in ordered[i:] if t[1] <= start), key=lambda t: t[1] + len(t[0]))
        out.append(best)
        reach = best[1] + len(best[0])
    return out


def phrases(query: str) -> list[list[Token]]:
    """Each white-space part of a query is a phrase, given by covering tokens with positions from its first."""
    out = []
    for part in query.split():
        tokens = covering(tokenize(part, index=False))
        if tokens:
            first = tokens[0][1]
            out.append([(t, p - first) for t, p in tokens])
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("position", T.IntegerType())])))
def index_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"term": a, "position": b} for a, b in tokenize(t)] if t else [])


@F.pandas_udf(T.IntegerType())
def normal_length(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(normal_chars(t)[0]) if t else 0)


def ascii_tokens(text: Column) -> Column:
    """Words of ASCII letters, digits and ``_`` in a lower-cased text, without leaving the JVM: array<string>."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), 0)


def word_tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) by Unicode word characters with inner apostrophes; the interface for a segmenter of languages
    without spaces, whose version an index records as ``ANALYZER``."""
    out = []
    for m in re.finditer(r"[^\W]+(?:['’][^\W]+)*", text):
        word = unicodedata.normalize("NFKC", m[0]).lower()
        if any(c.isalnum() for c in word):
            out.append((word, m.start(), m.end()))
    return out


ANALYZER = "unicode-words-1"

#: Fields of a note and what a match in each is worth.
FIELD_WEIGHTS = {"body": 1.0, "title": 3.0, "heading": 2.0, "path": 1.5}


def note_fields(path: str, content: str) -> dict[str, str]:
    headings = [line for line in re.split(r"\r?\n", content) if re.match(r"#{1,6}\s", line)]
    names = [re.sub(r"^#{1,6}\s+", "", h).strip() for h in headings]
    title = names[0] if names else path.rpartition("/")[2].removesuffix(".md")
    return {"body": content, "title": title, "heading": "\n".join(names), "path": path}


def query_phrases(query: str) -> list[list[str]]:
    """Quoted parts are phrases; each other word is one of its own."""
    out = []
    for quoted, plain in re.findall(r'"([^"]*)"|([^"]+)', query):
        words = [w for w, _, _ in word_tokens(quoted or plain)]
        if quoted and words:
            out.append(words)
        elif plain:
            out += [[w] for w in words]
    return out


def snippet(text: str, position: int, length: int, around: int = 40) -> str:
    """The original text around a match given in normalised characters."""
    _, source = normal_chars(text)
    if not source:
        return ""
    a, b = max(0, position - around), min(len(source), position + length + around)
    return text[source[a] : source[b - 1] + 1]


def markdown_chunks(path: str, content: str, most: int = 3500, whole: int = 4000) -> Iterator[tuple[str, str]]:
    """(text, heading): sections under headings of level 2 to 6, cut where they get too long for an embedding."""
    prefix = f"[{path}]\n"
    room = min(most, whole - len(prefix))
    if room <= 0:
        raise ValueError("the path leaves no room for text")
    heading, lines, size = path, [], 0

    def flush() -> Iterator[tuple[str, str]]:
        text = "\n".join(lines).strip()
        if text:
            yield prefix + text, heading

    for line in re.split(r"\r?\n", content):
        if re.match(r"#{2,6}\s+\S", line):
            yield from flush()
            heading, lines, size = re.sub(r"^#{2,6}\s+", "", line).strip(), [], 0
        if len(line) > room:
            yield from flush()
            lines, size = [], 0
            for a in range(0, len(line), room):
                if line[a : a + room].strip():
                    yield prefix + line[a : a + room].strip(), heading
            continue
        if lines and size + 1 + len(line) > room:
            yield from flush()
            lines, size = [], 0
        size += len(line) + (1 if lines else 0)
        lines.append(line)
    yield from flush()


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("heading", T.StringType())])))
def chunk_markdown(path: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([[{"text": t, "heading": h} for t, h in markdown_chunks(p, c)] if c else [] for p, c in zip(path, content, strict=True)])
