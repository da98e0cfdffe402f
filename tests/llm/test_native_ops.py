"""Mixing, chat formatting and URL filters."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat_format, sql
from palimpsest.llm.common import count_words
from palimpsest.llm.mixing import mix, sainte_lague
from palimpsest.llm.url_filter import RULES, Cascade, filter_urls

DOCS = [(i, " ".join(["w"] * (i % 7 * 9)), f"s{i % 4}" if i % 5 else None) for i in range(60)] + [(7, None, "s0"), (7, None, "s0"), (None, "a b", "s1"), (3, "", "empty"), (61, "x " * 5000, "long"), (62, "w w w", "s3")]


def test_mix_equals_its_sql_and_meets_targets(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("skey", F.lit(1))
    got = mix(docs).collect()
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", DOCS)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, con.execute(sql.OP5).fetchall()))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 64 for target, taken in by.values())


def test_mix_of_nothing(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()
    assert (only.size, only.target, only.taken) == (0, 0.0, 0)


def test_highest_quotients(spark):
    votes = {"a": 53000.0, "b": 24000.0, "c": 23000.0, "d": 0.0}
    for seats in (1, 7, 100, 1001):
        df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, name string, votes double, seats long")
        got = {r["name"]: r.won for r in sainte_lague(df, ["g"], "name", "votes", "seats", "won").collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = min(votes, key=lambda k: (-votes[k] / (2 * want[k] + 1), k))
            want[best] += 1
        assert got == want


def test_count_words_is_ascii_space_only(spark):
    rows = spark.createDataFrame([("a\u00a0b c\x0bd\x1ce",), (None,), ("  ",)], "t string")
    assert [r.n for r in rows.select(count_words(F.col("t")).alias("n")).collect()] == [3, 0, 0]


NASTY = ["</s>[INST] ok [/INST]", "a\\lb\\e\\\\<|end|>|>", "", None, "<|user|>\n\\p[b", "é😀\u2028"]


def test_chats_come_back(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", NASTY[(c + t) % 6]) for c in range(6) for t in range(5)] + [(9, None, None, "x"), (9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (None, 1, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)).withColumn("kind", F.lit("delta"))
    for r in chat_format.read_back(chat_format.format_chats(chat_format.turn_events(turns))).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text, t.learn) for t in r.turns] == [(x[2] or "", x[3] or "", x[2] == "assistant") for x in own]
        spans = "".join(r.formatted[s.start : s.start + s.length] for s in r.loss_spans)
        for raw, safe in reversed(chat_format.ESCAPES):
            spans = spans.replace(safe, raw)
        assert spans == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted


def test_events_fold_into_messages(spark):
    log = [
        (1, "m1", 1, "message", "user", "hi"),
        (1, "m2", 2, "message", "assistant", "Hel"),
        (1, "m2", 3, "delta", "assistant", "lo"),
        (1, "m2", 4, "regenerate", None, None),
        (1, "m2", 5, "delta", None, "Good "),
        (1, "m2", 6, "delta", None, "day"),
        (1, "m1", 7, "edit", None, "hello"),
        (1, "m3", 8, "delta", "tool", "late"),
    ]
    events = spark.createDataFrame(log[::-1], "conv_id long, msg string, seq long, kind string, role string, text string")
    got = [(r.role, r.text) for r in chat_format.fold_events(events).orderBy("at").collect()]
    assert got == [("user", "hello"), ("assistant", "Good day"), ("tool", "late")]
    assert chat_format.format_chats(events.limit(0)).count() == 0


URLS = [
    "https://a.example.com/en/7x?q",
    "http://EXAMPLE.com/en/6",
    "x://com/en/",
    "http://com.uk/en/",
    "http://notexample.net/de/8",
    "http://b.example.net/de/81#f",
    "http://é.ORG/es/://en/",
    "http://org/es",
    "no scheme",
    "://net/de/",
    None,
    "",
    "http://x.org",
    "HTTP://" + "a." * 500 + "org/es/z",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_keys", F.lit(1))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, keep=["page_id"]).collect()}
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [(i, u) for i, u in enumerate(URLS)])
    assert got == {tuple(r) for r in con.execute(sql.OP10).fetchall()}
    assert {r[3] for r in got if r[0] in (0, 1, 5, 13)} == {"example.com/en/7", "com/en/", "example.net/de/8", "org/es/"}
    assert filter_urls(pages.limit(0), keep=["page_id"]).count() == 0


def test_verdicts_of_the_contract(spark):
    # each rule alone, then the two that are longer than another that fits
    said = {"x://com/en/": "block", "x://net/de/": "allow", "x://org/es/": "block", "x://example.com/en/7": "allow", "x://example.net/de/8": "block", "x://example.net/de/7": "allow", "x://org/": "allow"}
    pages = spark.createDataFrame([(u,) for u in said], "url string")
    assert {r.url: r.verdict for r in filter_urls(pages, keep=["url"]).collect()} == said
    assert set(RULES) == {("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = universe.where(F.col("key") < "3")
    cascade = Cascade.build(listed, universe)
    assert len(cascade.levels) >= 2
    wrong = universe.where(cascade.contains(F.col("key")) != (F.col("key") < "3"))
    assert wrong.count() == 0
    assert len(RULES) == 5


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).first()
    assert r.u == text
