"""Predicates and keys over file paths, and daily notes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_slashes(path: str) -> str:
    return re.sub("/+", "/", path).strip("/")


def under_any(path: Column, bases: Sequence[str]) -> Column:
    """Whether the path is one of the folders or lies in one; empty folders are ignored.  Pushes down as prefix tests."""
    tests = [(path == b) | path.startswith(b + "/") for b in map(trim_slashes, bases) if b]
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def normal_folders(folders: Sequence[str]) -> list[str]:
    return sorted({t for f in folders if (t := trim_slashes(f))})


def is_hidden(path: Column) -> Column:
    """A segment begins with a dot."""
    return path.rlike(r"(^|/)\.")


def is_markdown(path: Column) -> Column:
    return path.endswith(".md")


def is_safe(path: Column) -> Column:
    """A relative path without control characters, backslashes or empty, ``.`` and ``..`` segments."""
    bad = path.rlike(r"[\x00-\x1f\x7f\\]") | F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce((F.length(path) > 0) & ~bad, F.lit(False))


def is_indexable(path: Column, reserved: Sequence[str] = (), excluded: Sequence[str] = (), hide: bool = False) -> Column:
    test = is_markdown(path) & ~under_any(path, reserved) & ~under_any(path, excluded)
    return test & ~is_hidden(path) & ~path.startswith("i:") if hide else test


def doc_id_for(path: Column, fold_case: bool = False) -> Column:
    name = F.lower(path) if fold_case else path
    return F.when(name.startswith("_"), F.concat(F.lit("/"), name)).otherwise(name)


def natural_key(path: Column, width: int = 20) -> Column:
    """Sorts runs of digits by value: each is padded with zeros; upper and lower case go together, then apart."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p))
    return F.concat(F.array_join(padded, ""), F.lit("\u0000"), path)


def level_entry(path: Column, directory: str) -> Column:
    """(type, name, path) of what stands for the path in a listing of its directory; null if it is not in it."""
    base = trim_slashes(directory)
    prefix = base + "/" if base else ""
    rest = F.substring(path, len(prefix) + 1, 1 << 30)
    name = F.substring_index(rest, "/", 1)
    kind = F.when(rest.contains("/"), "directory").otherwise("file")
    return F.when(path.startswith(prefix) & (F.length(rest) > 0), F.struct(kind.alias("type"), name.alias("name"), F.concat(F.lit(prefix), name).alias("path")))


def note_date(path: Column) -> Column:
    """The date that a daily note is named after, ``YYYY-MM-DD``; null if it is no date."""
    name = F.regexp_extract(path, r"(?:^|/)(\d{4})-?(\d{2})-?(\d{2})\.md$", 0)
    dashed = F.regexp_extract(path, r"(?:^|/)(\d{4}-\d{2}-\d{2})\.md$", 1)
    plain = F.regexp_extract(path, r"(?:^|/)(\d{8})\.md$", 1)
    text = F.when(dashed != "", dashed).when(plain != "", F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2)))
    return F.when((name != "") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def daily_note_path(date: str, folder: str = "", pattern: str | None = None, newest: str | None = None) -> str:
    """Where a new daily note goes: by pattern, else like the newest one there is, else ``Daily/<date>.md``."""
    if pattern:
        y, m, d = date.split("-")
        name = re.sub(r"\[([^\]]*)\]", r"\1", pattern)
        for token, value in (("YYYY", y), ("YY", y[2:]), ("MM", m), ("DD", d)):
            name = name.replace(token, value)
        return "/".join(p for p in (trim_slashes(folder), name) if p) + ".md"
    if newest:
        head, _, name = newest.rpartition("/")
        name = date.replace("-", "") if re.fullmatch(r"\d{8}\.md", name) else date
        return (head + "/" if head else "") + name + ".md"
    return f"Daily/{date}.md"


# Media types by extension.
MEDIA_TYPES = {
    "md": "text/markdown; charset=utf-8",
    "txt": "text/plain; charset=utf-8",
    "json": "application/json",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "pdf": "application/pdf",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "mp4": "video/mp4",
}


def media_type(path: Column, declared: Column | None = None) -> Column:
    """The declared type where it is a short text without control characters, else that of what follows the last point."""
    table = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    named = F.coalesce(F.try_element_at(table, F.lower(F.substring_index(path, ".", -1))), F.lit("application/octet-stream"))
    if declared is None:
        return named
    return F.when((F.length(declared) <= 128) & ~declared.rlike(r"[\x00-\x1f\x7f]"), declared).otherwise(named)
