"""One document store as an object: reads and writes over a table of revisions, under a policy."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import paths
from .functions.hashing import content_hash
from .functions.selector import compile_selector
from .operators import content, feed, fulltext, listing, revisions
from .sources.documents import body_variant, metadata


@dataclass(frozen=True)
class Policy:
    """What of a store may be seen and indexed, and in which time zone its days are."""

    reserved: Sequence[str] = field(default_factory=tuple)
    excluded: Sequence[str] = field(default_factory=tuple)
    time_zone: str = "UTC"
    hide_dots: bool = False

    def today(self, now: datetime.datetime | None = None) -> str:
        now = now or datetime.datetime.now(datetime.timezone.utc)
        try:
            zone: datetime.tzinfo = ZoneInfo(self.time_zone)
        except (ZoneInfoNotFoundError, ValueError):
            zone = datetime.timezone.utc
        return now.astimezone(zone).strftime("%Y-%m-%d")

    def visible(self, path: Column) -> Column:
        shown = ~paths.under_any(path, self.reserved)
        return shown & ~paths.is_hidden(path) if self.hide_dots else shown

    def indexable(self, path: Column) -> Column:
        return paths.is_indexable(path, self.reserved, self.excluded, self.hide_dots)


class Vault:
    """``revs`` as in operators.revisions, with JSON bodies.  Each write gives a new Vault; nothing is changed in place."""

    def __init__(self, revs: DataFrame, policy: Policy = Policy(), unrestricted: bool = False):
        self.revs, self.policy, self._all = revs, policy, unrestricted

    def unrestricted(self) -> Vault:
        """The same store without reserved paths."""
        return Vault(self.revs, self.policy, True)

    # documents

    def info(self) -> DataFrame:
        return feed.info(revisions.docs(self.revs))

    def changes(self, **options) -> DataFrame:
        selector = options.pop("selector", None)
        match = compile_selector(selector, body_variant(F.col("body"))) if selector else None
        return feed.changes(self.revs, match=match, **options)

    def find(self, selector: dict, limit: int | None = None) -> DataFrame:
        return feed.find(revisions.winners(self.revs), compile_selector(selector, body_variant(F.col("body"))), limit)

    def edit(self, edits: DataFrame) -> tuple[Vault, DataFrame]:
        after, answer = revisions.apply_edits(self.revs, edits)
        return Vault(after, self.policy, self._all), answer

    def replicate(self, batch: DataFrame) -> Vault:
        return Vault(revisions.replicate(self.revs, batch), self.policy, self._all)

    # files

    def _current(self) -> DataFrame:
        won = revisions.winners(self.revs).withColumn("_doc", body_variant(F.col("body"))).withColumn("_m", metadata(F.col("_doc")))
        return won.select("id", "rev", "deleted", "body", "_doc", "_m.*")

    def files(self) -> DataFrame:
        rows = self._current().where(listing.file_filter())
        return rows if self._all else rows.where(self.policy.visible(F.col("path")))

    def list_files(self) -> DataFrame:
        return self.files().select("path", "type", "size", "mtime").orderBy("path")

    def list_directory(self, directory: str = "") -> DataFrame:
        return listing.list_directory(self.files().where(paths.is_markdown(F.col("path"))), directory)

    def list_recent(self, limit: int = 20) -> DataFrame:
        return listing.recent(self.files().where(paths.is_markdown(F.col("path"))), limit)

    def read_notes(self, wanted: Sequence[str] | None = None) -> DataFrame:
        """(path, content, hash); null content where a chunk is missing."""
        rows = self.files()
        rows = rows if wanted is None else rows.where(F.col("path").isin(list(wanted)))
        data = F.try_variant_get("_doc", "$.data", "variant")
        # a variant of any kind can be had as text, so the kind is asked for
        text = F.when(F.schema_of_variant(data) == "STRING", F.try_variant_get("_doc", "$.data", "string"))
        inline = F.coalesce(text, F.array_join(F.try_variant_get("_doc", "$.data", "array<string>"), ""))
        notes = rows.select("id", "path", inline.alias("inline"), F.try_variant_get("_doc", "$.children", "array<string>").alias("children"), F.from_json(F.get_json_object("body", "$.eden"), "map<string,struct<data:string>>").alias("_eden"))
        notes = notes.withColumn("eden", F.transform_values("_eden", lambda _, v: v["data"])).drop("_eden")
        chunks = self._current().where(~F.col("deleted")).select("id", text.alias("data")).where("data is not null")
        whole = content.reassemble(notes.select("id", "children", "eden"), chunks)
        out = notes.join(whole, "id").select("path", F.coalesce("inline", "content").alias("content"))
        return out.withColumn("hash", content_hash(F.col("content")))

    def grep(self, query: str, limit: int = 10, folder: str = "") -> DataFrame:
        """Full-text hits (path, score, match_count); a folder narrows hits, not scores."""
        notes = self.read_notes().where("content is not null").where(self.policy.indexable(F.col("path")))
        sizes = fulltext.lengths(notes, "path", "content")
        accept = notes.where(F.col("path").startswith(paths.trim_slashes(folder) + "/")).select("path") if folder else None
        from .functions.tokens import phrases

        return fulltext.search(fulltext.exact_token_rows(notes, "path", "content"), sizes, phrases(query), limit, "path", accept)

    def daily_notes(self, limit: int = 20) -> DataFrame:
        return listing.daily_notes(self.files().select("path"), limit)
