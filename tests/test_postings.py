"""The stored index against an index that is made anew."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.tokens import ascii_tokens
from palimpsest.operators import fulltext, postings
from palimpsest.operators.heads import StaleHead
from palimpsest.operators.postings import SegmentIndex

NOTES = "path string, hash string, content string"


@pytest.fixture
def index(spark, tmp_path):
    return SegmentIndex(spark, f"file://{tmp_path}/index")


def found(index, query, **options):
    return {r.path: r.score for r in index.search(fulltext.word_phrases(query), None, **options).collect()}


def test_an_index_that_grew_equals_one_made_anew(spark, tmp_path, index):
    index.append(spark.createDataFrame([("a", "1", "red fish blue fish"), ("b", "1", "one fish"), ("c", "1", None)], NOTES), "1")
    index.append(spark.createDataFrame([("a", "1", "not read, the hash is known"), ("b", "2", "two red fish"), ("d", "1", "red"), ("e", "1", "blue fish")], NOTES), "2")
    index.append(spark.createDataFrame([("d", None, None), ("z", None, None)], NOTES), "3")
    anew = SegmentIndex(spark, f"file://{tmp_path}/anew")
    anew.append(spark.createDataFrame([("a", "1", "red fish blue fish"), ("b", "2", "two red fish"), ("c", "1", ""), ("e", "1", "blue fish")], NOTES), "all")
    queries = ("fish", "red", '"red fish"', 'fish "blue fish"', "one", "absent", "")
    want = {q: found(anew, q) for q in queries}
    assert set(want['"red fish"']) == {"a", "b"} and not want["one"] and not want["absent"] and not want[""]
    assert index.version()["totals"] == anew.version()["totals"]
    for merged in (False, True):
        if merged:
            index.merge([s["name"] for s in index.version()["segments"]])
            assert len(index.version()["segments"]) == 1
        for q in queries:
            got = found(index, q)
            assert got.keys() == want[q].keys() and all(math.isclose(got[p], want[q][p]) for p in got), q
        assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, anew.terms().collect()))


def test_merging_neighbours_keeps_deletions(spark, index):
    for n, rows in enumerate(([("a", "1", "x"), ("b", "1", "x")], [("a", None, None)], [("c", "1", "x")])):
        index.append(spark.createDataFrame(rows, NOTES), str(n))
    segments = [s["name"] for s in index.version()["segments"]]
    index.merge(segments[1:])
    assert found(index, "x").keys() == {"b", "c"} and len(index.version()["segments"]) == 2
    swept = index.sweep(keep=1)
    assert sorted(swept) == sorted(segments[1:]) and found(index, "x").keys() == {"b", "c"}


def test_one_writer_and_no_batch_twice(spark, index):
    index.append(spark.createDataFrame([("a", "1", "x")], NOTES), "1")
    assert index.append(spark.createDataFrame([("b", "1", "x")], NOTES), "1")["number"] == 1
    with pytest.raises(StaleHead):
        index.heads.put(0, {})
    index.append(spark.createDataFrame([], NOTES), "2")
    assert index.version()["number"] == 2 and len(index.version()["segments"]) == 1


def test_hits_that_are_out_of_date_are_passed_over(spark, index):
    index.append(spark.createDataFrame([("a", "1", "x x"), ("b", "1", "x"), ("b", "0", "old x")], NOTES), "1")
    now = spark.createDataFrame([("a", "2"), ("b", "1")], "path string, hash string")
    assert [r.path for r in index.search([[("x", 0)]], 1, validate=now).collect()] == ["b"]


def test_postings_are_made_and_sorted_in_the_task_of_their_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PART_CHARS", 2000)
    index = SegmentIndex(spark, f"file://{tmp_path}/parts")
    notes = [(f"d{i}", "1", " ".join(f"w{i * j % 97}" for j in range(60))) for i in range(200)]
    index.append(spark.createDataFrame(notes, NOTES), "1")
    rows = spark.read.parquet(f"file://{tmp_path}/parts/postings").select("path", "term_hash", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    parts = {}
    for r in rows.orderBy("at").collect():
        parts.setdefault(r.file, []).append(r)
    assert len(parts) > 8
    assert all([r.term_hash for r in p] == sorted(r.term_hash for r in p) for p in parts.values())
    # each document in one part
    assert sum(len({r.path for r in p}) for p in parts.values()) == len(notes)


@pytest.mark.parametrize("chars", [100, 500, 24_000_000])
def test_liveness_is_tested_without_a_shuffle_of_postings(spark, index, monkeypatch, chars):
    # segments of whole parts, one of them, none
    monkeypatch.setattr(postings, "PART_CHARS", chars)
    notes = [(f"d{i:03}", "1", f"x w{i}") for i in range(200)]
    index.append(spark.createDataFrame(notes, NOTES), "1")
    index.append(spark.createDataFrame([(p, "2", "y") for p, _, _ in notes[::3]] + [("new", "1", "x")], NOTES), "2")
    index.append(spark.createDataFrame([(p, None, None) for p, _, _ in notes[::7]], NOTES), "3")
    alive = {p for i, (p, _, _) in enumerate(notes) if i % 3 and i % 7} | {"new"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in index.terms()._jdf.queryExecution().executedPlan().toString()
        for merged in (False, True):
            if merged:
                # numbers of documents go on from one segment to the next
                index.merge([s["name"] for s in index.version()["segments"]][:2])
                docs = [r.doc for r in index._docs(index.version()["segments"][:1]).collect()]
                assert len(set(docs)) == len(docs)
            assert found(index, "x").keys() == alive
            assert {r.term: (r.df, r.cf) for r in index.terms().where("term in ('x', 'y')").collect()} == {"x": (len(alive), len(alive)), "y": (len([i for i in range(0, 200, 3) if i % 7]),) * 2}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [1, 40, 2_000_000])
def test_postings_in_batches_equal_those_of_columns(spark, monkeypatch, most):
    monkeypatch.setattr(fulltext, "BATCH_CHARS", most)
    texts = ["The cat, the dog", "", None, "İi K_k ſ Σ ÉÉ", "a" * 300 + " b\x00c\n7", "¡!", "x y x y x", "ＡＢ c"]
    docs = spark.createDataFrame([(i, t, (t or "")[:5]) for i, t in enumerate(texts)], "id long, a string, b string")
    got = fulltext.field_postings(docs, ["id"], {"A": "a", "B": "b"})
    want = []
    for field, c in (("A", "a"), ("B", "b")):
        sized = docs.withColumn("length", F.size(ascii_tokens(F.col(c))))
        want += [(r.term, r.id, field, r.length, r.positions) for r in fulltext.row_postings(sized, ["id", "length"], c).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [tuple(r) for r in docs.select(fulltext.n_words(F.lower("a"))).collect()] == [(r[0] or 0,) for r in docs.select(F.greatest(F.size(ascii_tokens(F.col("a"))), F.lit(0))).collect()]


def test_merged_postings_are_not_sorted(spark):
    docs = spark.createDataFrame([("a", 1, "p", "h", 3), ("b", 1, "p", "h", 3), ("b", 2, "q", "h", 3)], "segment string, doc long, path string, hash string, chars long")
    posts = spark.createDataFrame([("a", "x", 1, [0]), ("b", "x", 1, [0]), ("b", "y", 2, [0])], "segment string, term string, doc long, positions array<int>")
    _, moved = fulltext.merge_segments(docs, posts, docs.select("path", "hash").distinct())
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.term, r.doc) for r in moved.collect()) == [("x", 0), ("y", 1)]
