"""Registered queries against plain Python: every row of the input counts."""

from __future__ import annotations

import datetime
import hashlib
import re

import pytest

from palimpsest.operators import log
from palimpsest.plans import recipes
from palimpsest.plans.queries import QUERIES


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """Events of users 1 to 6, of which user 3 has a chain of 150 generations."""
    start = datetime.datetime(2024, 1, 1)
    users = [3] * 200 + [1, 2, 4, 5, 5, 6, 6, 6, 6, 6]
    rows = [(i, start + datetime.timedelta(minutes=i), u, "view", 1.0, "{}") for i, u in enumerate(users)]
    folder = f"{tmp_path_factory.mktemp('deep')}"
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def test_gc_unreachable_walks_every_chain_to_its_end(spark, deep):
    revs = {(r.id, r.rev): r for r in recipes.revs(spark, deep).collect()}
    live = set()
    for doc in {i for i, _ in revs}:
        at = max((r.gen, r.rev) for (i, _), r in revs.items() if i == doc)[1]
        while at is not None:
            live.add((doc, at))
            at = revs[doc, at].parent_rev
    assert max(r.gen for r in revs.values()) == 150
    got = [tuple(r) for r in QUERIES["gc_unreachable"](spark, deep).collect()]
    assert sorted(got) == sorted(set(revs) - live) and got


def test_doubling_on_cycles_and_shared_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("y", "x"), ("s", "s")], "source string, target string")
    for root, want in (("a", "abc"), ("y", "abcxy"), ("s", "s"), ("z", "z")):
        roots = spark.createDataFrame([(root,)], "node string")
        assert "".join(sorted(r.node for r in log.reachable_up(roots, edges).collect())) == want


TEXTS = {0: "The cat, the dog", 1: "a cat", 2: "", 3: "Über_x 7 the", 4: "dog dog dog", 6: "!", 9: "the end of the end"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def _postings(text):
    out = {}
    for i, term in enumerate(re.findall(r"[a-z0-9_]+", text.lower())):
        out.setdefault(term, []).append(str(i))
    return {t: ",".join(p) for t, p in out.items()}


def test_postings_of_all_documents(spark, corpus):
    got = sorted(tuple(r) for r in QUERIES["postings"](spark, corpus).select("term", "doc_id", "tf", "positions").collect())
    assert got == sorted((t, d, p.count(",") + 1, p) for d, text in TEXTS.items() for t, p in _postings(text).items())


def test_segments_of_all_documents_with_their_postings(spark, corpus):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    # merged in order of segment: a has every document, those of each fourth in an old version; b has the even ones
    kept = [d for d in TEXTS if d % 4] + [d for d in TEXTS if d % 4 == 0]
    want = []
    for n, d in enumerate(kept):
        words = [int(md5(f"{t}:{p}")[:15], 16) for t, p in _postings(TEXTS[d]).items()]
        want.append((n, str(d), md5(TEXTS[d]), len(TEXTS[d]), len(words), str(sum(words))))
    assert sorted(tuple(r) for r in QUERIES["segment_compact"](spark, corpus).collect()) == want
    assert sorted(tuple(r) for r in QUERIES["fresh_hits"](spark, corpus).collect()) == sorted((str(d), md5(TEXTS[d])) for d in TEXTS if d % 4)


def test_base64_of_many_bytes_is_one_line(spark, tmp_path):
    # 40 characters of three bytes each: their base64 has more than the 76 characters that Spark puts in a line
    texts = {0: "語" * 50, 5: "a", 6: "語" * 50}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in QUERIES["base64_strict"](spark, f"{tmp_path}").collect()}
    assert got == {d: hashlib.md5(t[:40].encode()).hexdigest() if d % 5 == 0 else None for d, t in texts.items()}
