from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from palimpsest.operators.index import ParquetIndex
from palimpsest.operators.local_docs import write_local
from palimpsest.vault import Policy, Vault

REVS = "id string, rev string, gen long, parent_rev string, seq long, deleted boolean, body string, body_available boolean"


def store(spark):
    bodies = [
        ("h:a", {"type": "leaf", "data": "# Hello\n"}),
        ("h:b", {"type": "leaf", "data": "会議室 world"}),
        ("n1", {"type": "plain", "path": "notes/hello.md", "children": ["h:a", "h:b"], "mtime": 5000, "size": 3}),
        ("n2", {"type": "newnote", "path": "pic.png", "children": ["h:a"]}),
        ("n3", {"type": "plain", "path": "gone.md", "children": ["h:a"], "deleted": True}),
        ("n4", {"type": "plain", "path": "secret/x.md", "data": ["a", "b"]}),
        ("n5", {"type": "plain", "path": "lost.md", "children": ["h:none"]}),
        ("n6", {"type": "plain", "path": "eden.md", "children": ["h:e"], "eden": {"h:e": {"data": "own"}}}),
    ]
    rows = [(i, "1-a", 1, None, n + 1, False, json.dumps(b), True) for n, (i, b) in enumerate(bodies)]
    return Vault(spark.createDataFrame(rows, REVS), Policy(reserved=["secret"]))


def test_vault(spark):
    v = store(spark)
    assert [r.path for r in v.list_files().collect()] == ["eden.md", "lost.md", "notes/hello.md", "pic.png"]
    got = {r.path: r.content for r in v.read_notes().collect()}
    assert got == {"notes/hello.md": "# Hello\n会議室 world", "pic.png": "# Hello\n", "lost.md": None, "eden.md": "own"}
    assert {r.path: r.content for r in v.unrestricted().read_notes(["secret/x.md"]).collect()} == {"secret/x.md": "ab"}
    assert [r.path for r in v.grep("会議").collect()] == ["notes/hello.md"] and v.grep("会議", folder="other").count() == 0
    assert [(r.type, r.name) for r in v.list_directory().collect()] == [("directory", "notes"), ("file", "eden.md"), ("file", "lost.md")]
    assert v.list_recent().first().modified_at == "1970-01-01T00:00:05.000Z"
    assert [r.id for r in v.find({"type": "newnote"}).collect()] == ["n2"]
    assert [r.id for r in v.changes(selector={"type": {"$ne": "leaf"}}, limit=2).collect()] == ["n1", "n2"]
    edits = spark.createDataFrame([(0, "n1", "1-a", True, "{}")], "pos int, id string, parent string, deleted boolean, body string")
    after, _ = v.edit(edits)
    assert tuple(after.info().first()) == (7, 1, 9)


def test_policy():
    noon = datetime.datetime(2024, 1, 1, 20, tzinfo=datetime.timezone.utc)
    assert Policy(time_zone="Asia/Tokyo").today(noon) == "2024-01-02" and Policy(time_zone="No/Where").today(noon) == "2024-01-01"


def test_local_documents(spark):
    none = spark.createDataFrame([], "id string, rev string, body string")
    schema = "pos int, id string, rev string, body string, deleted boolean"
    after, answer = write_local(none, spark.createDataFrame([(0, "c", None, '{"n":1}', False), (1, "c", None, '{"n":2}', False)], schema))
    assert sorted((r.pos, r.status) for r in answer.collect()) == [(0, "ok"), (1, "conflict")]
    rev = after.first().rev
    assert rev.startswith("0-") and len(rev) == 18
    gone, answer = write_local(after, spark.createDataFrame([(0, "c", rev, None, True), (1, "d", "0-x", "{}", False)], schema))
    assert gone.count() == 0 and sorted((r.pos, r.status) for r in answer.collect()) == [(0, "ok"), (1, "conflict")]


def test_index_generations(spark, tmp_path):
    index = ParquetIndex(spark, f"file://{tmp_path}/index")
    notes = spark.createDataFrame([("a.md", "1", "new york city"), ("b.md", "1", "york new")], "path string, hash string, content string")
    index.upsert(notes, "v1")
    assert [r.path for r in index.search('"new york"').collect()] == ["a.md"]
    assert {r.path for r in index.search("york").collect()} == {"a.md", "b.md"}
    assert [r.path for r in index.search("york", accept=F.col("path") != "a.md").collect()] == ["b.md"]
    building = index.begin_rebuild()
    building.upsert(notes.where("path = 'b.md'"), "v2")
    assert index.search("york").count() == 2
    index.complete_rebuild(building)
    assert index.search("york").count() == 1 and index.search("").count() == 0
    index.delete(notes.select("path"), "v3")
    assert index.search("york").count() == 0
