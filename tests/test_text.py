from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import paths, tokens
from palimpsest.functions.args import clamp, feed_limit, key_value, row_limit, since_value
from palimpsest.functions.hashing import ancestor_revs, chunk_id, fnv1a, split_units, stable_json, strict_base64
from palimpsest.operators import content, fulltext, listing


def test_words_and_pairs():
    got = tokens.tokenize("会議室でFooBarXを使う")
    assert ("foobarx", 4) in got and ("会議", 0) in got and ("議室", 1) in got and ("室で", 2) in got
    assert ("会", 0) in got and ("で", 3) in got
    assert tokens.tokenize("ＡＢＣ foo_bar!") == [("abc", 0), ("foo_bar", 4)]
    assert tokens.tokenize("") == tokens.tokenize("、。 !") == []


def test_covering_tokens():
    (phrase,) = tokens.phrases("会議室")
    assert phrase == [("会議", 0), ("議室", 1)]
    (phrase,) = tokens.phrases("会議室予約会議室予約")
    assert [p for _, p in phrase] == [0, 2, 4, 6, 8]


CORPUS = [("a", "京都の会議室を予約"), ("b", "FooBarX 会議と室"), ("c", "第1回 東京議会"), ("d", "会議室")]


@pytest.mark.parametrize("query,want", [("会議室", {"a", "d"}), ("京都", {"a"}), ("議と室", {"b"}), ("都会", set()), ("foobarx", {"b"}), ("foo", set()), ("第1回", {"c"}), ("会議室 予約", {"a"}), ("", set())])
def test_phrase_search(spark, query, want):
    docs = spark.createDataFrame(CORPUS, "doc_id string, text string")
    hits = fulltext.search_text(fulltext.exact_token_rows(docs), fulltext.lengths(docs), query)
    assert {r.doc_id for r in hits.collect()} == want


def test_bm25_against_plain_numbers(spark):
    texts = {0: "a b a c", 1: "a d", 2: "b b b", 3: "c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes = docs.select("doc_id", F.size(tokens.ascii_tokens(F.col("text"))).alias("length"))
    hits = fulltext.search(fulltext.token_rows(docs), sizes, [[("a", 0)], [("b", 0)]])
    (hit,) = hits.collect()
    plain = lambda tf: math.log(1 + (4 - 2 + 0.5) / (2 + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 4 / 2.5))
    want = plain(2) + plain(1)
    assert hit.doc_id == 0 and math.isclose(hit.score, want) and hit.match_count == 3
    assert fulltext.search(fulltext.token_rows(docs), sizes, [[("a", 0), ("c", 1)]]).first().doc_id == 0
    assert fulltext.search(fulltext.token_rows(docs), sizes, [[("a", 0), ("a", 1)]]).count() == 0


def test_quoted_phrases():
    assert tokens.query_phrases('"new york" city') == [["new", "york"], ["city"]]
    with pytest.raises(ValueError):
        fulltext.word_phrases(" ".join(f"w{i}" for i in range(40)))


def test_markdown_chunks():
    long = "a" * 5000 + " tailneedle"
    chunks = list(tokens.markdown_chunks("n.md", long))
    assert len(chunks) == 2 and all(len(t) <= 4000 for t, _ in chunks) and "tailneedle" in chunks[-1][0]
    many = "\n".join(f"## h{i}\ntext" for i in range(60))
    assert [h for _, h in tokens.markdown_chunks("n.md", many)] == [f"h{i}" for i in range(60)]
    assert list(tokens.markdown_chunks("n.md", "# one\nx"))[0][1] == "n.md"
    assert list(tokens.markdown_chunks("n.md", " \n")) == []


def test_snippet():
    assert tokens.snippet("x" * 100 + "needle" + "y" * 100, 100, 6) == "x" * 40 + "needle" + "y" * 40


def test_stable_json():
    assert stable_json({"b": [1, 2.5, 1e21, 1e-7, -0.0], "a": {"z": None, "y": True}}) == '{"a":{"y":true,"z":null},"b":[1,2.5,1e+21,1e-7,0]}'
    assert stable_json(123456789012345680000) == "123456789012345680000"
    assert stable_json({"": 1, "\U00010000": 2}).index("\U00010000") < stable_json({"": 1, "\U00010000": 2}).index("")


def test_pieces_and_ids(spark):
    assert list(split_units("ab😀c", 3)) == ["ab", "😀c"]
    got = spark.createDataFrame([("# Today",)], "t string").select(chunk_id(F.col("t")).alias("c")).first().c
    assert got.startswith("h:k") and len(got) == 43
    assert fnv1a("") == 0x811C9DC5 and fnv1a("a") == 0xE40C292C
    rows = spark.createDataFrame([("YQ==",), ("YQ=",), ("Y Q==",), ("",)], "t string").select(strict_base64(F.col("t")).alias("b"))
    assert [None if r.b is None else bytes(r.b) for r in rows.collect()] == [b"a", None, None, b""]
    named = spark.range(1).select(ancestor_revs(F.lit(2), F.array(F.lit("c"), F.lit("b"), F.lit("a"))).alias("r")).first().r
    assert named == ["2-c", "1-b"]


def test_reassembly(spark):
    chunks = spark.createDataFrame([("h:a", "# Hello\n"), ("h:b", "world")], "id string, data string")
    notes = spark.createDataFrame([("n", ["h:a", "h:b", "h:a"], {}), ("gap", ["h:a", "h:x"], {}), ("eden", ["h:x"], {"h:x": "own"}), ("empty", [], {}), ("none", None, {})], "id string, children array<string>, eden map<string,string>")
    got = {r.id: r.content for r in content.reassemble(notes, chunks).collect()}
    assert got == {"n": "# Hello\nworld# Hello\n", "gap": None, "eden": "own", "empty": "", "none": None}
    waits = content.missing_children(notes, chunks).collect()
    assert {r.id: r.missing for r in waits} == {"gap": ["h:x"], "eden": ["h:x"]}
    pieces = content.chunk_note(spark.createDataFrame([("n", "x" * 250_000), ("e", "")], "id string, content string"))
    assert [len(r.data) for r in pieces.orderBy("pos").collect()] == [100_000, 100_000, 50_000]


def test_paths(spark):
    files = spark.createDataFrame([("a/b10.md",), ("a/b9.md",), ("a/c/d.md",), ("z.md",), (".git/x.md",), ("a/../x",)], "path string")
    assert [r.name for r in listing.list_directory(files, "a").collect()] == ["..", "c", "b9.md", "b10.md"]
    assert [r.path for r in files.where(paths.is_hidden(F.col("path"))).collect()] == [".git/x.md", "a/../x"]
    assert {r.path for r in files.where(~paths.is_safe(F.col("path"))).collect()} == {"a/../x"}
    assert {r.path for r in files.where(paths.under_any(F.col("path"), ["/a/c/", ""])).collect()} == {"a/c/d.md"}
    days = spark.createDataFrame([("d/2024-02-29.md",), ("d/20240230.md",), ("20240301.md",), ("d/x2024-01-01.md",)], "path string")
    assert [(r.date, r.path) for r in listing.daily_notes(days).collect()] == [("2024-03-01", "20240301.md"), ("2024-02-29", "d/2024-02-29.md")]
    assert paths.daily_note_path("2024-05-06", "log", "YYYY/[week] MM-DD") == "log/2024/week 05-06.md"
    assert paths.daily_note_path("2024-05-06", newest="j/20240505.md") == "j/20240506.md"
    assert paths.daily_note_path("2024-05-06") == "Daily/2024-05-06.md"


def test_arguments():
    assert [since_value(x, 9) for x in (3, "12", "now", "x", None, True)] == [3, 12, 9, 0, 0, 0]
    assert [row_limit(x) for x in (None, 5, -2, "7", "x")] == [None, 5, 0, 7, 0]
    assert feed_limit(None, False) == 1000 and feed_limit(9000, False) == 5000 and feed_limit(0, True) == 1 and feed_limit(500, True) == 128
    assert key_value('"a"') == "a" and key_value("raw") == "raw" and clamp("x", 1, 5, 3) == 3
