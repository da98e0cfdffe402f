"""A stored inverted index: segments of postings, written once and read by term.

A segment is a folder of documents (path, hash, chars, lengths, doc) and one of postings, in parts of about ``PART_CHARS``
of text that are each sorted by the hash of the term, so a query reads the pages that hold its terms.  A document's postings
are in one part, made and sorted in the task that has its text: no posting is shuffled.  Merged segments are copied part by
part, without those of documents that no longer count; only segments smaller than a part are dealt and sorted anew.  A posting carries the length of its
field, so scores need no other table, and the number of its document in the segment.

Documents of older segments that no longer count are told by one bit for each number, 64 in a row of a table that is
broadcast (about a row's size for each 64 dead documents, never more than one for each 64 documents), so postings are
filtered where they are read.

A version of the index names its segments, the oldest first, and its totals.  Later segments replace what earlier ones have
under the same path; a document without a hash is a deletion.  Totals are kept up by what each append adds and replaces, so
they are exact without a scan.  Writers follow one another by ``Heads``: one that comes second finds its head stale, and
what it wrote is swept.

Defined results: texts that are null or have no word are documents without postings; a path that is given twice in a batch
counts once, by the greatest hash; an empty batch makes no segment; a query without phrases finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import FIELD_WEIGHTS
from ..session import cut
from . import fulltext
from .heads import Heads

#: Names the layout and the analyzer: an index of another one is not read.
LAYOUT = "3-ascii"

#: Characters that one part of a segment's postings is made of, about: some 3 million postings, which one task sorts.
PART_CHARS = 24_000_000

#: More segments than these are merged, the smallest first, up to so many characters in one.
SEGMENTS, SEGMENT_CHARS = 8, 16_000_000_000


def _parts(chars: int) -> int:
    return max(1, -(-chars // PART_CHARS))


def _within(rows: DataFrame) -> DataFrame:
    """Numbered by partition and place in it: 33 bits for the place."""
    return rows.withColumn("_at", F.monotonically_increasing_id())


def _numbered(rows: DataFrame) -> DataFrame:
    """``doc`` from 0 on, without holes, from the ``_at`` of rows that were kept; the driver sees one count per partition."""
    part = F.shiftright("_at", 33)
    starts, at = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):
        starts.append((r["part"], at - (r["part"] << 33)))
        at += r["count"]
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))
    return rows.withColumn("_part", part).join(before, "_part").withColumn("doc", F.col("_at") + F.col("_start")).drop("_part", "_start", "_at")


class SegmentIndex:
    """``fields``: names of text columns of the notes that are indexed, each with its own lengths and weight."""

    def __init__(self, spark: SparkSession, root: str, fields: Sequence[str] = ("content",), path_type: str = "string", generation: str = "active"):
        self.spark, self.root, self.fields, self.path_type = spark, root.rstrip("/"), tuple(fields), path_type
        self.heads = Heads(spark, f"{self.root}/versions-{generation}")

    # versions

    def version(self) -> dict:
        n = self.heads.head()
        return self.heads.read(n) | {"number": n} if n else {"number": 0, "batch": None, "segments": [], "totals": {"docs": 0, "with_words": 0, **dict.fromkeys(self.fields, 0)}}

    def _folder(self, kind: str, segments: Sequence[dict]) -> list[str]:
        return [f"{self.root}/{kind}/segment={s['name']}" for s in segments]

    def _read(self, kind: str, schema: str, segments: Sequence[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*self._folder(kind, segments))

    def _docs(self, segments: Sequence[dict]) -> DataFrame:
        return self._read("docs", f"path {self.path_type}, hash string, chars long, lengths map<string,int>, doc long, segment string", segments)

    def _postings(self, segments: Sequence[dict], terms: Sequence[str] | None = None) -> DataFrame:
        """All postings, or those of some terms, of which only the pages with their hashes are read."""
        rows = self._read("postings", f"term string, path {self.path_type}, field string, length int, positions array<int>, doc long, term_hash long, segment string", segments)
        if terms is None:
            return rows
        return rows.where(F.col("term_hash").isin(*(F.xxhash64(F.lit(t)) for t in terms)) & F.col("term").isin(list(terms)))

    def _placed(self, segments: Sequence[dict]) -> DataFrame:
        """All documents, those of a path numbered in ``_n`` from its last one on."""
        place = F.create_map(*(F.lit(x) for i, s in enumerate(segments) for x in (s["name"], i)))
        last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.element_at(place, F.col("segment")))))
        return self._docs(segments).withColumn("_n", last)

    def _live(self, segments: Sequence[dict]) -> DataFrame:
        """The documents that count: each path's last, if that is not its deletion."""
        if len(segments) <= 1:
            return self._docs(segments).where(F.col("hash").isNotNull())
        return self._placed(segments).where((F.col("_n") == 1) & F.col("hash").isNotNull()).drop("_n")

    def documents(self) -> DataFrame:
        """(path, hash, chars, lengths) of the current version."""
        return self._live(self.version()["segments"]).drop("segment")

    def _alone(self, rows: DataFrame, segments: Sequence[dict]) -> DataFrame:
        """Postings of documents that count."""
        if len(segments) <= 1:
            return rows
        dead = self._placed(segments).where((F.col("_n") > 1) & F.col("hash").isNotNull())
        bits = dead.groupBy("segment", F.shiftright("doc", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, int(doc % 64)))").alias("_bits"))
        found = rows.withColumn("_word", F.shiftright("doc", 6)).join(F.broadcast(bits), ["segment", "_word"], "left")
        return found.where(F.coalesce(F.getbit("_bits", (F.col("doc") % 64).cast("int")), F.lit(0)) == 0).drop("_word", "_bits")

    # writing

    def _write(self, docs: DataFrame, postings: DataFrame, name: str) -> None:
        """``postings`` as they are dealt and ordered: a partition is a part."""
        docs.select("path", "hash", "chars", "lengths", "doc").write.parquet(f"{self.root}/docs/segment={name}")
        postings.select("term", "path", "field", "length", "positions", "doc", "term_hash").write.parquet(f"{self.root}/postings/segment={name}")

    @staticmethod
    def _totals(docs: DataFrame, fields: Sequence[str]) -> dict[str, int]:
        sums = [F.coalesce(F.sum(F.element_at("lengths", f)), F.lit(0)).alias(f) for f in fields]
        words = F.aggregate(F.map_values("lengths"), F.lit(0), lambda a, x: a + x)
        got = docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if(words > 0).alias("with_words"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), *sums).first()
        return got.asDict()

    def _put(self, now: dict, segments: list[dict], totals: dict, batch: str) -> dict:
        self.heads.put(now["number"], {"batch": batch, "segments": segments, "totals": totals})
        return self.version()

    def append(self, notes: DataFrame, batch: str) -> dict:
        """Notes (path, hash, *fields) as a new segment, but for those that are there with the same hash; a note without a
        hash deletes its path.  A batch that was the last one is not taken again."""
        now = self.version()
        if now["batch"] == batch:
            return now
        live = cut(self._live(now["segments"]))
        newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc_nulls_last("hash")))
        texts = [f"_f{i}" for i in range(len(self.fields))]
        given = notes.select(F.col("path").cast(self.path_type).alias("path"), "hash", *(F.when(F.col("hash").isNotNull(), F.coalesce(f, F.lit(""))).otherwise(F.lit("")).alias(t) for f, t in zip(self.fields, texts, strict=True)))
        asked = given.withColumn("_n", newest).where("_n = 1").drop("_n").join(live.select("path", F.col("hash").alias("_old")), "path", "left")
        changed = cut(_within(asked.where(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")))
        if changed.isEmpty():
            return self._put(now, now["segments"], now["totals"], batch)
        changed = _numbered(changed)
        sizes = F.create_map(*(x for f, t in zip(self.fields, texts, strict=True) for x in (F.lit(f), fulltext.n_words(F.lower(t)))))
        chars = sum((F.length(t).cast("bigint") for t in texts), F.lit(0).cast("bigint"))
        docs = cut(changed.select("path", "hash", chars.alias("chars"), sizes.alias("lengths"), "doc"))
        added = self._totals(docs.where("hash is not null"), self.fields)
        gone = self._totals(live.join(docs.select("path"), "path", "left_semi"), self.fields)
        name = uuid.uuid4().hex
        own = changed.where("hash is not null").repartition(_parts(added["chars"]), "path")
        rows = fulltext.field_postings(own, ["path", "doc"], dict(zip(self.fields, texts, strict=True))).withColumn("term_hash", F.xxhash64("term"))
        self._write(docs, rows.sortWithinPartitions("term_hash"), name)
        totals = {k: v + added[k] - gone[k] for k, v in now["totals"].items()}
        return self._put(now, [*now["segments"], {"name": name, "docs": added["docs"], "chars": added["chars"], "numbers": docs.count()}], totals, batch)

    def merge(self, names: Sequence[str] | None = None) -> dict:
        """The named segments, or what ``plan`` names, as one in the place of the last of them: documents that no longer count
        are left out.  Deletions stay unless all segments are merged.  Totals do not change."""
        now = self.version()
        names = list(self.plan() if names is None else names)
        places = [i for i, s in enumerate(now["segments"]) if s["name"] in names]
        if len(places) < 2:
            return now
        # what lies between is merged as well, or a later segment would come to stand before an earlier one
        chosen = now["segments"][places[0] : places[-1] + 1]
        whole = len(chosen) == len(now["segments"])
        live = self._live(now["segments"]).join(F.broadcast(self.spark.createDataFrame([(s["name"],) for s in chosen], "segment string")), "segment")
        deleted = self._docs(chosen).where("hash is null").join(live.select("path"), "path", "left_anti").dropDuplicates(["path"])
        # a segment's numbers come after those of the ones before it
        starts, at = [], 0
        for s in chosen:
            starts += [F.lit(s["name"]), F.lit(at).cast("long")]
            at += s["numbers"]
        renumbered = F.col("doc") + F.element_at(F.create_map(*starts), F.col("segment"))
        docs = (live if whole else live.unionByName(deleted)).withColumn("doc", renumbered).drop("segment")
        docs = cut(docs)
        size = self._totals(docs.where("hash is not null"), self.fields)
        name = uuid.uuid4().hex
        # segments of whole parts keep them as sorted runs, so their postings are neither shuffled nor sorted; those of small
        # ones are sorted together
        alive = lambda own: self._alone(self._postings(own), now["segments"]).withColumn("doc", renumbered)
        small = [s for s in chosen if s["chars"] < PART_CHARS]
        rows = alive(small).repartition(_parts(sum(s["chars"] for s in small)), "path").sortWithinPartitions("term_hash") if small else None
        if large := [s for s in chosen if s["chars"] >= PART_CHARS]:
            rows = alive(large) if rows is None else alive(large).unionByName(rows)
        self._write(docs, rows, name)
        merged = [*now["segments"][: places[0]], {"name": name, "docs": size["docs"], "chars": size["chars"], "numbers": at}, *now["segments"][places[-1] + 1 :]]
        return self._put(now, merged, now["totals"], f"merge-{name}")

    def plan(self) -> list[str]:
        """The neighbours that are smallest together, if there are too many segments and one may hold them."""
        own = self.version()["segments"]
        if len(own) <= SEGMENTS:
            return []
        size, i = min((own[i]["chars"] + own[i + 1]["chars"], i) for i in range(len(own) - 1))
        return [own[i]["name"], own[i + 1]["name"]] if size <= SEGMENT_CHARS else []

    def sweep(self, keep: int = 2) -> list[str]:
        """Deletes the segments that none of the last ``keep`` versions of any generation names; their names."""
        named: set[str] = set()
        for folder in self.heads.names(self.root):
            if folder.startswith("versions-"):
                heads = Heads(self.spark, f"{self.root}/{folder}")
                named |= {s["name"] for n in heads.numbers()[-keep:] for s in heads.read(n)["segments"]}
        gone = sorted({f.removeprefix("segment=") for kind in ("docs", "postings") for f in self.heads.names(f"{self.root}/{kind}")} - named)
        for name in gone:
            for folder in self._folder("docs", [{"name": name}]) + self._folder("postings", [{"name": name}]):
                self.heads.delete(folder)
        return gone

    def adopt(self, built: SegmentIndex, batch: str) -> dict:
        """Another generation's segments and totals in the place of this one's."""
        other = built.version()
        return self._put(self.version(), other["segments"], other["totals"], batch)

    # reading

    def terms(self) -> DataFrame:
        """(term, df, cf) of the current version."""
        segments = self.version()["segments"]
        rows = self._alone(self._postings(segments), segments)
        found = rows.select("term", "path", F.size("positions").cast("long").alias("n"))
        # with one field a document that counts has one posting of a term
        by_doc = found if len(self.fields) == 1 else found.groupBy("term", "path").agg(F.sum("n").alias("n"))
        return by_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))

    def search(self, wanted: Sequence[Sequence[tuple[str, int]]], limit: int | None = 10, weights: dict[str, float] | None = None, accept: Column | None = None, validate: DataFrame | None = None, fields: Sequence[str] | None = None, by_words: bool = False) -> DataFrame:
        """(path, score, match_count, hash): documents with every phrase in some field, best first; all without a limit.

        Of all fields or the named ones.  ``accept`` tests paths and ``validate`` (path, hash) names hits that are up to date; neither changes scores.  With
        ``by_words`` documents without a word do not count in the statistics."""
        now = self.version()
        segments, totals = now["segments"], now["totals"]
        if not wanted or not segments:
            return self.spark.createDataFrame([], f"path {self.path_type}, score double, match_count long, hash string")
        terms = sorted({t for phrase in wanted for t, _ in phrase})
        rows = self._postings(segments, terms)
        rows = self._alone(rows if fields is None else rows.where(F.col("field").isin(list(fields))), segments)
        if all(len(set(phrase)) == 1 for phrase in wanted):
            # phrases of one word each: a posting is a match
            words = self.spark.createDataFrame([(i, phrase[0][0]) for i, phrase in enumerate(wanted)], "phrase int, term string")
            matches = rows.join(F.broadcast(words), "term").select("phrase", F.size("positions").cast("long").alias("tf"), "path", "field", "length")
        else:
            place = F.struct("path", "field", "length")
            matches = fulltext.phrase_matches(rows.select("term", place.alias("place"), F.explode("positions").alias("position")), wanted, "place")
            matches = matches.select("phrase", "tf", "place.*")
        df = matches.groupBy("phrase", "path").agg(F.lit(1).alias("x")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
        n = max(totals["with_words"] if by_words else totals["docs"], 1)
        weigh = {**{f: FIELD_WEIGHTS.get(f, 1.0) for f in self.fields}, **(weights or {})}
        average = F.create_map(*(F.lit(x) for f in self.fields for x in (f, max(totals[f] / n, 1.0))))
        weight = F.create_map(*(F.lit(x) for f in self.fields for x in (f, float(weigh[f]))))
        own = F.element_at(weight, F.col("field")) * fulltext.bm25(F.lit(n), F.col("df"), F.col("tf"), F.col("length"), F.element_at(average, F.col("field")))
        scored = matches.join(F.broadcast(df), "phrase").withColumn("s", own)
        hits = scored.groupBy("path").agg(F.sum("s").alias("score"), F.sum("tf").alias("match_count"), F.count_distinct("phrase").alias("_p")).where(F.col("_p") == len(wanted)).drop("_p")
        hits = hits.where(accept) if accept is not None else hits
        if validate is not None:
            live = self._live(segments).select("path", "hash")
            hits = hits.join(live, "path").join(validate.select("path", F.col("hash").alias("_now")), "path").where(F.col("hash") == F.col("_now")).drop("_now")
        else:
            hits = hits.withColumn("hash", F.lit(None).cast("string"))
        return hits.orderBy(F.desc("score"), "path").limit(limit) if limit is not None else hits
