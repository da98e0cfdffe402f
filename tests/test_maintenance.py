"""Segments, logs, mirrors, vectors, timers and streams."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import fulltext, log, mirror, revisions, vectors
from palimpsest.sources import change_source, documents
from palimpsest.streaming import consumer, windows


def test_merge_equals_rebuild(spark):
    docs = spark.createDataFrame([("a", 0, "x", "h1", 5), ("a", 1, "y", "old", 5), ("b", 0, "y", "h2", 6), ("b", 1, "x", "h1", 5)], "segment string, doc int, path string, hash string, chars int")
    posts = spark.createDataFrame([("a", "t", 0, [1]), ("a", "t", 1, [2]), ("b", "t", 0, [3]), ("b", "u", 1, [4])], "segment string, term string, doc int, positions array<int>")
    live = spark.createDataFrame([("x", "h1"), ("y", "h2")], "path string, hash string")
    d, p = fulltext.merge_segments(docs, posts, live)
    assert sorted((r.doc, r.path) for r in d.collect()) == [(0, "x"), (1, "y")]
    assert sorted((r.term, r.doc, r.positions) for r in p.collect()) == [("t", 0, [1]), ("t", 1, [3])]
    freed = fulltext.rewrite_plan(docs, live, least=5).collect()
    assert [(r.segment, r.freed) for r in freed] == [("a", 5)]
    sizes = spark.createDataFrame([(f"s{i}", i) for i in range(9)], "segment string, chars long")
    assert fulltext.merge_plan(sizes) == ["s0", "s1"] and fulltext.merge_plan(sizes.limit(8)) == []


def test_freshness(spark):
    hits = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, hash string")
    state = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "1", None), ("d", "1", None)], "path string, hash string, fts_hash string")
    assert sorted(r.path for r in fulltext.fresh(hits, state).collect()) == ["a", "c", "d"]


def test_overlay(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c", False), (1, "", True), (3, "d", False)], "k int, v string, gone boolean")
    assert sorted(map(tuple, fulltext.overlay(base, delta, ["k"]).collect())) == [(2, "c"), (3, "d")]


def test_log_commits_one_writer(spark, tmp_path):
    events = log.EventLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([("k", 1, False), ("l", 2, False)], "key string, seq int, gone boolean")
    assert events.head() == 0 and events.commit(rows, 0) == 1
    with pytest.raises(log.StaleHead):
        events.commit(rows, 0)
    later = spark.createDataFrame([("k", 3, True), ("m", 4, False)], "key string, seq int, gone boolean")
    assert events.commit(later, events.head()) == 2
    everything = events.events().drop("commit_no")
    snapshot = log.state_at(everything, ["key"], "seq", until=2)
    after = log.replay(snapshot, events.events(after=1).drop("commit_no"), ["key"], "seq")
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, log.state_at(everything, ["key"], "seq").collect())) == [("l", 2, False), ("m", 4, False)]
    assert events.garbage() == []


def test_unreachable(spark):
    edges = spark.createDataFrame([("h", "c2"), ("c2", "c1"), ("c1", "o1"), ("x", "o2")], "source string, target string")
    objects = spark.createDataFrame([(n,) for n in ("c1", "c2", "o1", "o2", "x")], "node string")
    assert sorted(r.node for r in log.unreachable(objects, spark.createDataFrame([("h",)], "node string"), edges).collect()) == ["o2", "x"]


def test_mirror(spark, tmp_path):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, fingerprint string")
    there = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "path string, fingerprint string")
    assert sorted(map(tuple, mirror.delta(now, there).collect())) == [("a", "put"), ("b", "keep"), ("c", "put"), ("d", "remove")]
    files = spark.createDataFrame([("x/y.md", "plain", "é"), ("z.bin", "newnote", "AAE="), ("bad", "newnote", "AAE")], "path string, kind string, content string")
    done = mirror.write_files(files.withColumn("bytes", mirror.decode(F.col("kind"), F.col("content"))).where("bytes is not null"), str(tmp_path))
    assert sorted(map(tuple, done.collect())) == [("x/y.md", 2), ("z.bin", 2)]
    assert (tmp_path / "x/y.md").read_text() == "é" and (tmp_path / "z.bin").read_bytes() == b"\0\1"
    kinds = spark.createDataFrame([("e_x", "plain", 1), ("d", "other", 1), ("d", "plain", 1 << 40), ("d", "plain", 1)], "id string, kind string, size long")
    assert [r.u for r in kinds.select(mirror.unsupported(F.col("id"), F.col("kind"), F.col("size")).alias("u")).collect()] == ["encrypted", "kind", "size", None]


def test_vectors(spark):
    notes = spark.createDataFrame([("a.md", "# A\nx\n## B\ny"), ("b.md", "")], "path string, content string")
    chunks = vectors.embed(vectors.plan_chunks(notes), lambda texts: [[float(i), 1.0] for i, _ in enumerate(texts)])
    assert sorted((r.path, r.chunk_index, r.heading) for r in chunks.collect()) == [("a.md", 0, "a.md"), ("a.md", 1, "B")]
    index = spark.createDataFrame([("old", "a.md", "h", [1.0, 0.0]), ("b", "b.md", "h2", [1.0, 1.0]), ("c", "c.md", None, [1.0, 0.0])], "id string, path string, hash string, values array<float>")
    fresh = spark.createDataFrame([("a.md", "new"), ("b.md", "h2"), ("c.md", "h3")], "path string, hash string")
    assert [r.id for r in vectors.top_k(index, [1.0, 0.0], fresh=fresh).collect()] == ["c", "b"]


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_timers(spark):
    e = spark.createDataFrame([("k", at(s)) for s in (0, 60, 170, 400, 401)], "k string, ts timestamp_ntz")
    assert sorted((r.started, r.fires, r.events) for r in windows.debounce(e, ["k"], "ts", 120).collect()) == [(at(0), at(290), 3), (at(400), at(521), 2)]
    assert sorted((r.started, r.events) for r in windows.coalesce(e, ["k"], "ts", 100).collect()) == [(at(0), 2), (at(170), 1), (at(400), 2)]
    tries = spark.createDataFrame([("k", at(s), bad) for s, bad in [*((i, True) for i in range(11)), (30, False), (1000, False)]], "k string, ts timestamp_ntz, bad boolean")
    got = {r.ts: r.locked for r in windows.lockout(tries, ["k"], "ts", "bad").collect()}
    assert got[at(9)] is False and got[at(30)] is True and got[at(1000)] is False


def test_feed_as_a_stream(spark, tmp_path):
    change_source.register(spark)
    path = str(tmp_path / "changes")
    rows = [(s, f"d{s % 3}", f"{s}-r", s % 5 == 0) for s in range(1, 8)]
    spark.createDataFrame(rows, change_source.SCHEMA).write.parquet(path)
    assert spark.read.format("changefeed").option("path", path).option("startingSeq", "5").load().count() == 2
    assert spark.read.format("changefeed").option("path", path).option("startingSeq", "now").load().count() == 0
    table = consumer.VersionedTable(spark, f"file://{tmp_path}/current")

    def derive(batch):
        return batch.groupBy("id").agg(F.max_by(F.struct("rev", "deleted"), "seq").alias("w")).select("id", "w.rev", F.col("w.deleted").alias("gone"))

    def follow():
        stream = spark.readStream.format("changefeed").option("path", path).load()
        q = consumer.follow(stream, consumer.upsert_batch(table, ["id"], derive), f"file://{tmp_path}/ckpt", once=False)
        q.processAllAvailable()
        q.stop()

    follow()
    assert sorted(map(tuple, table.read().collect())) == [("d0", "6-r"), ("d1", "7-r")]
    spark.createDataFrame([(8, "d2", "8-r", False), (9, "d0", "9-r", True)], change_source.SCHEMA).write.mode("append").parquet(path)
    follow()
    assert sorted(map(tuple, table.read().collect())) == [("d1", "7-r"), ("d2", "8-r")]


def test_late_chunks(spark):
    notes = spark.createDataFrame([("n", ["a", "b"]), ("m", ["a"])], "id string, children array<string>")
    ready, waiting = consumer.ready_notes(notes, spark.createDataFrame([("a", "x")], "id string, data string"))
    assert [tuple(r) for r in ready.collect()] == [("m", "x")] and [r.id for r in waiting.collect()] == ["n"]


def test_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"_id":"a","path":"p.md","size":3,"deleted":true}\nbroken\n{"_id":"b","path":5,"mtime":"x"}\n')
    got = {r.id: r.meta for r in documents.read_documents(spark, f"file://{tmp_path}/d.json").collect()}
    assert got["a"].path == "p.md" and got["a"].size == 3.0 and got["a"].soft_deleted is True
    assert got["b"].path is None and got["b"].mtime is None and None in got
    documents.check_limits(spark.createDataFrame([("{}",)], "body string"))
    with pytest.raises(ValueError):
        documents.check_limits(spark.range(1001).select(F.lit("{}").alias("body")))


def test_a_mirror_stays_in_its_folder(spark, tmp_path):
    root = tmp_path / "mirror"
    root.mkdir()
    (root / "out").symlink_to(tmp_path)
    rows = spark.createDataFrame([("a/b.md", b"x"), ("../escaped.txt", b"x"), (str(tmp_path / "absolute.txt"), b"x"), ("out/linked.txt", b"x"), (None, b"x")], "path string, bytes binary")
    assert [r.path for r in mirror.write_files(rows, str(root)).collect()] == ["a/b.md"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["mirror"]


def test_public_documents(spark):
    rows = spark.createDataFrame([("a", "1-x", False, '{"_id":"b","_rev":"0-y","_conflicts":[],"v":{"w":[1,null]}}', ["1-x"]), ("d", "2-z", True, "{}", ["2-z", "1-q"])], "id string, rev string, deleted boolean, body string, history array<string>")
    got = {r.id: json.loads(r.doc) for r in revisions.public_doc(rows, history=True).collect()}
    assert got == {"a": {"_id": "a", "_rev": "1-x", "_revisions": {"start": 1, "ids": ["x"]}, "v": {"w": [1, None]}}, "d": {"_id": "d", "_rev": "2-z", "_deleted": True, "_revisions": {"start": 2, "ids": ["z", "q"]}}}


def test_feed_in_many_tasks(spark, tmp_path):
    change_source.register(spark)
    rows = spark.range(1, 1001).selectExpr("id as seq", "cast(id as string) as id", "'1-a' as rev", "false as deleted")
    rows.repartition(3).write.parquet(f"{tmp_path}/feed")
    feed = spark.read.format("changefeed").option("path", f"file://{tmp_path}/feed").option("rowsPerTask", 100)
    assert feed.load().rdd.getNumPartitions() == 10 and feed.load().selectExpr("count(*)", "sum(seq)").first()[:] == (1000, 500500)
    assert feed.option("startingSeq", "now").load().count() == 0
    assert feed.option("startingSeq", 950).load().count() == 50


def test_versions_of_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(consumer, "DELTAS", 2)
    table = consumer.VersionedTable(spark, f"file://{tmp_path}/table")
    run = consumer.upsert_batch(table, ["k"], lambda b: b)
    state = {}
    for n in range(6):
        rows = [(k, n, (k + n) % 5 == 0) for k in range(n, n + 4)]
        for _ in range(2):
            run(spark.createDataFrame(rows, "k int, v int, gone boolean"), n)
        state.update({k: v for k, v, _ in rows})
        for k, _, gone in rows:
            if gone:
                state.pop(k)
        assert {r.k: r.v for r in table.read().collect()} == state
    assert table.version()["number"] == 6
    with pytest.raises(log.StaleHead):
        table.heads.put(5, {})
