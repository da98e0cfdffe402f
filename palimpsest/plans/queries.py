"""One query per operator over the driver's tables; their SQL is in ``oracle.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, tokens
from ..functions import hashing
from ..functions.hashing import content_hash
from ..functions.selector import Value, compile_selector, js_number, number_column, text_column
from ..operators import content, feed, fulltext, listing, local_docs, log, mirror, revisions, vectors
from ..session import numbered, table
from ..streaming import windows
from . import recipes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Parameters that the SQL uses too.
SINCE, PAGE, RESERVED = 5000, 100, "en/src1"
FEED_SELECTOR = {"type": {"$ne": "view"}, "size": {"$gte": 20}}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(c: str) -> F.Column:
    return F.array_join(c, ",")


def _meta() -> dict[str, Value]:
    return {"type": text_column(F.col("type")), "size": number_column(F.col("size")), "mtime": number_column(F.col("mtime")), "_id": text_column(F.col("id")), "_rev": text_column(F.col("rev"))}


@query
def rev_leaves(spark, sf):
    return revisions.leaves(recipes.revs(spark, sf)).select("id", "rev", "gen", "deleted")


@query
def rev_winners(spark, sf):
    return revisions.docs(recipes.revs(spark, sf))


@query
def rev_conflicts(spark, sf):
    found = revisions.conflicts(recipes.revs(spark, sf))
    return found.select("id", F.size("conflicts").cast("bigint").alias("n"), _joined("conflicts").alias("conflicts"))


@query
def changes_main(spark, sf):
    page = feed.changes(recipes.revs(spark, sf), since=0, limit=PAGE)
    return page.select("seq", "id", _joined("revs").alias("revs"), "deleted")


@query
def changes_all_docs(spark, sf):
    page = feed.changes(recipes.revs(spark, sf), since=0, limit=PAGE, style="all_docs")
    return page.select("seq", "id", _joined("revs").alias("revs"), "deleted")


@query
def changes_selector(spark, sf):
    match = compile_selector(FEED_SELECTOR, typed=_meta())
    page = feed.changes(recipes.revs(spark, sf), since=0, limit=PAGE, style="all_docs", match=match)
    return page.select("seq", "id", _joined("revs").alias("revs"), "deleted")


@query
def changes_pending(spark, sf):
    current = revisions.docs(recipes.revs(spark, sf))
    page = feed.changes(recipes.revs(spark, sf), since=SINCE, limit=10, current=current)
    return feed.page_end(page, current, limit=10)


def _find(spark, sf, selector) -> DataFrame:
    won = revisions.winners(recipes.revs(spark, sf)).withColumn("_doc", F.try_parse_json("body"))
    match = compile_selector(selector, F.col("_doc"), _meta())
    return feed.matching(won, match).select("id", "rev", "body")


@query
def find_range(spark, sf):
    return _find(spark, sf, {"k": {"$gte": 10, "$lt": 60}})


@query
def find_in_nin(spark, sf):
    return _find(spark, sf, {"type": {"$in": ["click", "view", 3]}, "k": {"$nin": [1, 2, 3, "4"]}})


@query
def find_exists(spark, sf):
    return _find(spark, sf, {"k": {"$exists": True}, "none": {"$exists": False}})


@query
def find_regex(spark, sf):
    return _find(spark, sf, {"type": {"$regex": "^(click|p.*e)$"}})


@query
def find_or_and(spark, sf):
    return _find(spark, sf, {"$or": [{"type": "purchase"}, {"$and": [{"k": {"$gt": 50}}, {"size": {"$lt": 40}}]}]})


@query
def find_mixed_type_compare(spark, sf):
    # text against a number goes by text; a missing field reads "undefined"
    return _find(spark, sf, {"k": {"$lt": "5"}, "none": {"$gt": "a"}})


@query
def find_page(spark, sf):
    won = revisions.winners(recipes.revs(spark, sf)).withColumn("_doc", F.try_parse_json("body"))
    return feed.find(won, compile_selector({"k": {"$gte": 1}}, F.col("_doc"), _meta())).select("id", "rev")


@query
def numbers_as_text(spark, sf):
    price = F.col("o_totalprice") * 1000
    return table(spark, sf, "orders").select("o_orderkey", js_number(price).alias("shown"), compile_selector({"p": {"$lt": "5"}}, typed={"p": number_column(price)}).alias("below"))


@query
def all_docs_range(spark, sf):
    return feed.all_docs(revisions.docs(recipes.revs(spark, sf)), start="1", end="5", inclusive_end=False, limit=50, skip=3)


@query
def all_docs_desc(spark, sf):
    return feed.all_docs(revisions.docs(recipes.revs(spark, sf)), start="7", end="3", descending=True, limit=40)


@query
def all_docs_keys(spark, sf):
    keys = spark.createDataFrame([(0, "3"), (1, "none"), (2, "10"), (3, "3")], "pos int, key string")
    return feed.all_docs_keys(revisions.docs(recipes.revs(spark, sf)), keys).withColumn("deleted", F.coalesce("deleted", F.lit(False)))


@query
def revs_diff(spark, sf):
    r = recipes.revs(spark, sf)
    # every revision there is, and for each one that there is not
    wanted = r.select("id", "rev").unionByName(r.select("id", F.concat("rev", F.lit("x")).alias("rev")))
    found = revisions.revs_diff(wanted, r)
    return found.select("id", F.size("missing").cast("bigint").alias("n"), _joined("missing").alias("missing"))


@query
def bulk_get(spark, sf):
    r = recipes.revs(spark, sf)
    # by revision and, every other time, by id alone
    asked = r.select(F.col("seq").alias("pos"), "id", F.when(F.col("seq") % 2 == 0, F.col("rev")).otherwise(F.lit(None)).alias("rev"))
    return revisions.bulk_get(asked, r).withColumn("deleted", F.coalesce("deleted", F.lit(False)))


@query
def open_revs_latest(spark, sf):
    r = recipes.revs(spark, sf)
    found = revisions.descendants(r.select("id", "rev"), r)
    return found.groupBy("id", "rev").agg(F.count(F.lit(1)).alias("n"), F.min("leaf").alias("first"), F.max("leaf").alias("last"))


@query
def public_docs(spark, sf):
    r = recipes.revs(spark, sf)
    won = revisions.winners(r)
    return revisions.public_doc(won.select("id", "rev", "deleted", "body"), revisions.conflicts(r)).select("id", "doc")


@query
def replicate_batch(spark, sf):
    # the later half arrives as a batch, each revision with its parent; some parents are in the batch, some in the store
    r = recipes.revs(spark, sf)
    there = r.where(F.col("seq") <= SINCE).select("id", "rev", "gen", "parent_rev", "seq", "deleted", "body", "body_available")
    batch = r.where(F.col("seq") > SINCE).select(F.col("seq").alias("pos"), "id", "rev", "deleted", "body", F.array_compact(F.array("rev", "parent_rev")).alias("ancestry"))
    return revisions.replicate(there, batch).select("id", "rev", "gen", "parent_rev", "seq", "deleted", "body_available")


@query
def local_edits(spark, sf):
    # each live document gets an edit of its winner, and one of a parent that is no leaf, which is a conflict
    r = recipes.revs(spark, sf).select("id", "rev", "gen", "parent_rev", "seq", "deleted", "body", "body_available")
    won = revisions.docs(r).where(~F.col("deleted"))
    body = F.concat(F.lit('{"b":1,"a":"'), "id", F.lit('"}'))
    edits = won.select((F.col("updated_seq") * 2).alias("pos"), "id", F.col("winning_rev").alias("parent"), F.lit(False).alias("deleted"), body.alias("body"))
    stale = won.select((F.col("updated_seq") * 2 + 1).alias("pos"), "id", F.lit("1-none").alias("parent"), F.lit(False).alias("deleted"), body.alias("body"))
    _, answer = revisions.apply_edits(r, edits.unionByName(stale))
    return answer


@query
def local_checkpoints(spark, sf):
    # of two writes to each user's document the first is taken; users whose number is even have a revision that they must name
    users = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("at"))
    name = F.col("user_id").cast("string")
    store = users.where("user_id % 2 = 0").select(name.alias("id"), F.lit("0-old").alias("rev"), F.lit("{}").alias("body"))
    body = F.concat(F.lit('{"last_seq":'), F.col("at").cast("string"), F.lit("}"))
    first = users.select((F.col("user_id") * 2).alias("pos"), name.alias("id"), F.when(F.col("user_id") % 4 == 0, F.lit("0-old")).alias("rev"), body.alias("body"), F.lit(False).alias("deleted"))
    writes = first.unionByName(first.withColumn("pos", F.col("pos") + 1))
    after, answer = local_docs.write_local(store, writes)
    return answer.join(after.select("id", F.col("body").alias("now")), "id", "left").select("pos", "id", "rev", "status", "now")


@query
def link_ancestors(spark, sf):
    r = recipes.revs(spark, sf)
    # leaves arrive with their parent only: everything before is named by others or not at all
    arrived = revisions.leaves(r).select("id", "seq", F.array_compact(F.array("rev", "parent_rev")).alias("ancestry"))
    return revisions.link_ancestors(arrived).select("id", "rev", "parent_rev", "stub")


@query
def compact_changes(spark, sf):
    r = recipes.revs(spark, sf)
    return revisions.compact_changes(r.select("seq", "id"), revisions.docs(r))


@query
def compact_revs(spark, sf):
    done = revisions.compact(recipes.revs(spark, sf))
    return done.groupBy("id").agg(F.count(F.lit(1)).alias("revs"), F.count_if("body_available").alias("bodies"), F.sum(F.length("body")).alias("chars"))


@query
def db_info(spark, sf):
    return feed.info(revisions.docs(recipes.revs(spark, sf)))


@query
def index_status(spark, sf):
    labels = table(spark, sf, "labels")
    digest = F.md5(F.col("doc_id").cast("string"))
    state = labels.select(digest.alias("hash"), F.when(F.col("quality") == 1, digest).alias("fts_hash"), (F.col("toxic") == 1).alias("pending"))
    return listing.index_status(state)


@query
def reassemble(spark, sf):
    # a turn of every seventh conversation has not arrived
    turns = table(spark, sf, "conversations").where(~((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0)))
    done = content.reassemble_turns(turns, "conv_id", "turn", "text")
    return done.select("conv_id", "pieces", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("digest"))


@query
def list_files(spark, sf):
    return listing.list_files(recipes.files(spark, sf)).select("path", "size")


@query
def list_directory(spark, sf):
    return listing.list_directory(recipes.files(spark, sf), "en")


@query
def recent_notes(spark, sf):
    return listing.recent(recipes.files(spark, sf).where(listing.file_filter()), 20).select("path", "modified_at")


@query
def prefix_list(spark, sf):
    return listing.prefix_listing(recipes.files(spark, sf).where(listing.file_filter()), "de/src1", 100)


@query
def reserved_filter(spark, sf):
    rows = recipes.files(spark, sf).select("path")
    return rows.where(paths.is_indexable(F.col("path"), reserved=[RESERVED], excluded=["fr/"], hide=True))


@query
def similar_paths(spark, sf):
    return listing.similar_paths(recipes.files(spark, sf), "x/SRC12", 5).select("path")


@query
def daily_notes(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    name = F.when(F.col("user_id") % 2 == 0, day).otherwise(F.date_format("ts", "yyyyMMdd"))
    notes = table(spark, sf, "events").select(F.concat(F.lit("daily/"), F.col("user_id").cast("string"), F.lit("/"), name, F.lit(".md")).alias("path")).distinct()
    return listing.daily_notes(notes, 20)


@query
def hash_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


@query
def dedupe_content(spark, sf):
    docs = table(spark, sf, "documents").select(content_hash(F.col("text")).alias("hash"), "doc_id")
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query
def hash_skip(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    state = docs.select(path, content_hash(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))).alias("hash"))
    return content.changed(docs.select(path, content_hash(F.col("text")).alias("hash")), state)


@query
def chunk_content(spark, sf):
    pieces = content.fixed_pieces(table(spark, sf, "documents"), "doc_id", "text", 1000)
    return pieces.select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@query
def tokenize_words(spark, sf):
    words = tokens.ascii_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("digest"))


@query
def postings(spark, sf):
    return fulltext.row_postings(table(spark, sf, "documents")).select("term", "doc_id", "tf", _positions().alias("positions"))


def _positions() -> F.Column:
    return _joined(F.transform("positions", lambda p: p.cast("string")))


@query
def term_df(spark, sf):
    return fulltext.term_df(fulltext.token_rows(table(spark, sf, "documents")))


@query
def corpus_stats(spark, sf):
    docs = table(spark, sf, "documents")
    return fulltext.corpus_stats(fulltext.token_rows(docs), docs).withColumn("avg_length", F.round("avg_length", 6))


def _hits(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").alias("doc_id"), F.round("score", 6).alias("score"), "match_count")


@query
def search_bm25(spark, sf):
    return _hits(recipes.stored_index(spark, sf).search([[("the", 0)], [("of", 0)], [("thing", 0)]], 50, fields=["body"]))


@query
def search_phrase(spark, sf):
    return _hits(recipes.stored_index(spark, sf).search([[("of", 0), ("the", 1)]], 50, fields=["body"]))


@query
def search_fields(spark, sf):
    return _hits(recipes.stored_index(spark, sf).search([[("and", 0)], [("is", 0)]], 50, by_words=True))


@query
def index_append(spark, sf):
    return recipes.grown_index(spark, sf).terms()


@query
def index_merge(spark, sf):
    index = recipes.grown_index(spark, sf)
    index.merge([s["name"] for s in index.version()["segments"]])
    return index.terms()


@query
def index_search(spark, sf):
    # every document that has both, by an index of three segments
    return _hits(recipes.grown_index(spark, sf).search([[("the", 0)], [("of", 0), ("the", 1)]], None))


@query
def index_totals(spark, sf):
    totals = recipes.grown_index(spark, sf).version()["totals"]
    return spark.createDataFrame([(totals["docs"], totals["body"])], "docs long, words long")


def _segments(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two segments of the same files, of which the older one has every fourth file in an old version."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("doc"), "text")
    old = F.when(F.col("doc") % 4 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    a = docs.select(F.lit("a").alias("segment"), "doc", "path", old.alias("text"))
    b = docs.where("doc % 2 = 0").select(F.lit("b").alias("segment"), "doc", "path", "text")
    return a.unionByName(b).withColumns({"hash": F.md5("text"), "chars": F.length("text")}), docs.select("path", F.md5("text").alias("hash"))


@query
def segment_compact(spark, sf):
    segs, live = _segments(spark, sf)
    # dealt by document before its words are read, so that texts are shuffled and not their postings
    posts = fulltext.row_postings(segs.select("segment", "doc", "text").repartition("segment", "doc"), ["segment", "doc"])
    docs, merged = fulltext.merge_segments(segs.drop("text"), posts, live)
    # a document's merged postings as their number and, in any order, the sum of 60 bits of the MD5 of each term:positions
    line = F.md5(F.concat("term", F.lit(":"), _positions()))
    words = merged.select("doc", F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(20,0)").alias("line"))
    words = words.groupBy("doc").agg(F.count(F.lit(1)).alias("terms"), F.sum("line").cast("string").alias("postings"))
    found = docs.join(words, "doc", "left").withColumns({"terms": F.coalesce("terms", F.lit(0)), "postings": F.coalesce("postings", F.lit("0"))})
    return found.select("doc", "path", "hash", F.col("chars").cast("bigint").alias("chars"), "terms", "postings")


@query
def fresh_hits(spark, sf):
    segs, live = _segments(spark, sf)
    return fulltext.fresh(segs.where("segment = 'a'").select("path", "hash"), live.withColumn("fts_hash", F.col("hash"))).select("path", "hash")


@query
def vector_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    wanted = [round(((i * 37) % 64 - 31.5) / 100, 4) for i in range(64)]
    return vectors.top_k(rows, wanted, 20, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query
def gc_unreachable(spark, sf):
    r = recipes.revs(spark, sf)
    # the last revision of each document is a root; what does not lie on the way from it to the first is garbage
    objects = r.select(F.concat_ws("/", "id", "rev").alias("node"), "id", "rev")
    edges = r.where(F.col("parent_rev").isNotNull()).select(F.concat_ws("/", "id", "rev").alias("source"), F.concat_ws("/", "id", "parent_rev").alias("target"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("gen"), F.desc("rev")))
    last = r.withColumn("n", rank).where("n = 1").select(F.concat_ws("/", "id", "rev").alias("node"))
    return log.unreachable(objects, last, edges, forest=True).select("id", "rev")


@query
def snapshot_replay(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("gone"))
    snapshot = log.state_at(events, ["user_id"], "event_id", until=SINCE).select("user_id", "event_id", "value")
    return log.replay(snapshot, events.where(F.col("event_id") > SINCE), ["user_id"], "event_id")


@query
def mirror_delta(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    current = docs.where(F.col("doc_id") % 5 != 0).select(path, F.md5("text").alias("fingerprint"))
    there = docs.where(F.col("doc_id") % 7 != 0).select(path, F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))).alias("fingerprint"))
    return mirror.delta(current, there)


@query
def mirror_status(spark, sf):
    return mirror.status(mirror_delta(spark, sf).withColumnRenamed("action", "status"))


@query
def debounce_sessions(spark, sf):
    return windows.debounce(table(spark, sf, "events"), ["user_id"], "ts", 6 * 3600)


@query
def coalesce_fixed(spark, sf):
    return windows.coalesce(table(spark, sf, "events"), ["user_id"], "ts", 24 * 3600)


@query
def lockout(spark, sf):
    e = table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    return windows.lockout(e, ["user_id"], "ts", "failed", most=2, window=48 * 3600, hold=24 * 3600).select("event_id", "locked")


@query
def registry_authorized(spark, sf):
    nations = table(spark, sf, "nation")
    registry = nations.select(F.col("n_name").alias("vault"), F.col("n_regionkey").cast("string").alias("owner"), F.array((F.col("n_nationkey") % 4).cast("string")).alias("readers"))
    return listing.authorized(registry, "2").select("vault", "owner")


@query
def missing_chunks(spark, sf):
    turns = table(spark, sf, "conversations")
    notes = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))).alias("children"))
    have = turns.where(F.col("turn") % 3 != 0).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))
    found = content.missing_children(notes.withColumnRenamed("conv_id", "id"), have)
    return found.select("id", F.size("missing").cast("bigint").alias("n"), _joined("missing").alias("missing"))


@query
def media_types(spark, sf):
    names = ("png", "md", "bin", "PDF", "txt", "html", "css", "mp3", "wav", "mp4", "jpeg", "svg", "json", "md/x")
    kinds = F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("page_id") % len(names) + 1).cast("int"))
    rows = table(spark, sf, "pages").select(F.concat(F.lit("a.b/"), F.col("page_id").cast("string"), F.lit("."), kinds).alias("path"), F.when(F.col("page_id") % 5 == 0, F.lit("text/x-own")).when(F.col("page_id") % 5 == 1, F.lit("bad\n")).alias("own"))
    return rows.select("path", paths.media_type(F.col("path"), F.col("own")).alias("media_type"), paths.is_safe(F.col("path")).alias("safe"))


@query
def safe_paths(spark, sf):
    made = F.element_at(F.array(*(F.lit(x) for x in ("", "/", "../", "a/../", "a//", "./", "a\\", "a\x01/", "b/c/"))), (F.col("page_id") % 9 + 1).cast("int"))
    rows = table(spark, sf, "pages").select("page_id", F.concat(made, F.col("page_id").cast("string")).alias("path"))
    return rows.select("page_id", paths.is_safe(F.col("path")).alias("safe"), paths.is_hidden(F.col("path")).alias("hidden"))


@query
def base64_strict(spark, sf):
    good = hashing.plain_base64(F.encode(F.substring("text", 1, 40), "UTF-8"))
    tail = F.element_at(F.array(*(F.lit(x) for x in ("", "\n", "=", "A", " "))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.concat(good, tail).alias("code"))
    return rows.select("doc_id", F.md5(hashing.strict_base64(F.col("code"))).alias("digest"))


@query
def chunk_ids(spark, sf):
    pieces = content.chunk_note(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return pieces.select(F.col("id").alias("doc_id"), "pos", F.col("child").alias("chunk"), F.length("data").alias("chars"))


@query
def stored_chunks(spark, sf):
    pieces = content.chunk_note(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return content.store_chunks(pieces).select("id", F.md5("data").alias("digest"))


@query
def dependent_notes(spark, sf):
    # notes that list a chunk which has changed
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.md5("text").alias("chunk"))
    notes = turns.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "chunk"))).alias("c")).select("id", F.transform("c", lambda x: x["chunk"]).alias("children"))
    return content.dependents(turns.where("turn = 1").select(F.col("chunk").alias("id")).distinct(), notes)


@query
def term_shards(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(tokens.ascii_tokens(F.col("text"))).alias("term")).distinct()
    return words.groupBy(hashing.term_shard(F.col("term")).alias("shard"), hashing.term_bucket(F.col("term")).alias("bucket")).agg(F.count(F.lit(1)).alias("terms"))


@query
def revision_parts(spark, sf):
    r = recipes.revs(spark, sf)
    return r.select("id", "rev", hashing.rev_generation(F.col("rev")).alias("gen"), hashing.rev_digest(F.col("rev")).alias("digest"), hashing.rev_generation(F.concat(F.lit("x"), "rev")).alias("none"))


@query
def vector_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", hashing.vector_id(F.col("url"), F.col("page_id").cast("string")).alias("id"))


@query
def natural_order(spark, sf):
    # places of all files' names in natural order
    files = recipes.files(spark, sf).select("path", paths.natural_key(F.col("path")).alias("key"))
    return numbered(files, "place", "key").select("path", "place")


@query
def mirror_sources(spark, sf):
    docs = table(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 7 == 0, F.lit("leaf")).when(F.col("doc_id") % 3 == 0, F.lit("newnote")).otherwise(F.lit("plain"))
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("e_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", name.alias("id"), kind.alias("kind"), F.col("n_chars").alias("size"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("code"), "text")
    content_of = F.when(F.col("kind") == "newnote", F.col("code")).otherwise(F.col("text"))
    return rows.select("doc_id", mirror.unsupported(F.col("id"), F.col("kind"), F.col("size"), most=5000).alias("reason"), F.md5(mirror.decode(F.col("kind"), content_of)).alias("digest"))


@query
def retry_delays(spark, sf):
    return table(spark, sf, "events").select("event_id", mirror.retry_delay((F.col("event_id") % 12).cast("int"), F.lit(0.5)).alias("seconds"))


@query
def stale_rewrite(spark, sf):
    segs, live = _segments(spark, sf)
    return fulltext.rewrite_plan(segs, live.select("path", "hash"), share=0.1, least=1)


@query
def overlay_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    delta = docs.where("doc_id % 4 = 0").select("doc_id", F.md5("digest").alias("digest"), (F.col("doc_id") % 8 == 0).alias("gone"))
    return fulltext.overlay(docs, delta, ["doc_id"])


@query
def appended_blocks(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("content"))
    return content.append_block(texts, "- [ ] task").select(F.col("id").alias("doc_id"), F.md5("content").alias("digest"))
