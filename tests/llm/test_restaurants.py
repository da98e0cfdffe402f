"""The language model against plain restaurants: how customers are seated, and what probabilities follow."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import pitman_yor as py


@pytest.mark.parametrize("count,weight,discount", [(2, 0.3, 0.5), (40, 2.0, 0.8), (300, 0.5, 0.7), (3000, 30.0, 0.6), (20_000, 4.0, 0.75)])
def test_tables_are_those_of_a_plain_chinese_restaurant(count, weight, discount):
    n = 4000
    rng = np.random.default_rng(7)
    plain = np.ones(n)
    for seated in range(1, count):
        plain += rng.random(n) * (weight + seated - discount * plain) < weight
    got = py._seat(np.full(n, count), np.full(n, weight), discount, np.random.default_rng(8))
    error = 4 * (plain.std() + got.std()) / math.sqrt(n)
    assert abs(got.mean() - plain.mean()) <= error + 0.002 * plain.mean()
    assert abs(got.std() - plain.std()) <= 0.1 * plain.std() + 0.05


def seated(texts, sweeps=2):
    """A seating of all words of some texts in one bucket, with the totals after it."""
    counts = Counter()
    words = py._Words()
    for t in texts:
        counts.update(zip(*(x.tolist() for x in words(t)), strict=True))
    by_word = defaultdict(dict)
    for (w, c), n in counts.items():
        by_word[w][c] = n
    order = sorted(by_word)
    names = [sorted(by_word[w]) for w in order]
    blob = py._pack(
        np.array(order, np.uint64), np.array([len(x) for x in names], np.uint32), np.array([c for x in names for c in x], np.uint32), np.array([by_word[w][c] for w, x in zip(order, names, strict=True) for c in x], np.uint32)
    )
    s = py.Seating(blob, 0)
    t = s.totals()
    for i in range(sweeps):
        s.sweep(t, (0.7, 0.7, 0.7), i)
        t = s.totals()
    return s, t


def texts():
    r = random.Random(4)
    words = [f"w{i}ing" if i % 3 else f"v{i}ed" for i in range(40)]
    return [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(40)], k=r.randint(0, 60))) for _ in range(60)]


def test_probabilities_are_those_of_the_restaurants():
    s, t = seated(texts())
    # the tables of every restaurant as plain dictionaries
    low, mid, top = defaultdict(dict), defaultdict(dict), {}
    at = np.repeat(np.arange(len(s.word)), np.diff(np.append(s.starts, len(s.key))))
    for i, w in enumerate(at):
        low[int(s.name[i])][int(w)] = (int(s.count[i]), int(s.tables[i]))
    for i, w in enumerate(s.parent_at):
        mid[int(s.parent_name[i])][int(w)] = (int(s.parent_count[i]), int(s.parent_tables[i]))
    for i in range(len(s.word)):
        top[i] = (int(s.word_count[i]), int(s.word_tables[i]))

    def p(word, dishes, below):
        customers, tables = (sum(x[k] for x in dishes.values()) for k in (0, 1))
        c, n = dishes.get(word, (0, 0))
        return (c - 0.7 * n + (1.0 + 0.7 * tables) * below) / (1.0 + customers)

    contexts = sorted({int(c) for c in s.name})[:12] + [5]
    for c in contexts:
        name = np.full(len(s.word) + 1, c, np.uint32)
        words = np.append(s.word, np.uint64(123456789))
        got = s.probability(t, (0.7, 0.7, 0.7), s.find(words, name), name)
        for i in range(len(words)):
            one = p(i, top, 1 / (len(s.word) + 1))
            want = p(i, low[c], p(i, mid[c >> py.LOW], one))
            assert got[i] == pytest.approx(want, rel=1e-9)
        assert got.sum() == pytest.approx(1)


def test_every_customer_and_table_is_counted_above():
    s, _ = seated(texts())
    assert (s.tables >= 1).all() and (s.tables <= s.count).all()
    assert s.parent_count.sum() == s.tables.sum() and s.word_count.sum() == s.parent_tables.sum()


def test_scores_do_not_depend_on_partitions_and_repeated_rows_are_scored_each(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3])] * 3 + [(1000, "the " * 50_000), (1001, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in py.score(docs.repartition(n)).collect()) for n in (2, 5))
    assert a == b and len(a) == len(rows)
    assert len({x for x in a if x[0] == 3}) == 1 and sum(x[0] == 3 for x in a) == 4


def test_a_hot_word_has_copies_of_its_bucket(spark, monkeypatch):
    monkeypatch.setattr(py, "BUCKET_CHARS", 2_000)
    monkeypatch.setattr(py, "BATCH", 500)
    docs = spark.createDataFrame([(i, t + " hot" * 40) for i, t in enumerate(texts())], "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r for r in py.score(docs).collect()}
    seen = []
    plain = py._copies
    monkeypatch.setattr(py, "_copies", lambda *a: seen.append(plain(*a)) or ([*range(len(seen[-1][0]))], [1] * len(seen[-1][0])))
    one = {r.doc_id: r for r in py.score(docs).collect()}
    assert max(seen[0][1]) > 1
    assert whole.keys() == one.keys() and all(math.isclose(whole[i].score, one[i].score, rel_tol=1e-9) and whole[i].n_known == one[i].n_known for i in one)
    assert docs.where(F.col("doc_id") < 0).count() == 0
