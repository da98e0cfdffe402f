"""Near-duplicates, neighbours, the language model and the pipeline, against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import near_dup, nearest, pitman_yor
from palimpsest.llm.hilbert import hilbert_index

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(repr((d, len(sets[i]), low[find(i)] if d is not None else None)) for i, (d, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(30)]
    base = [rng.choice(words) for _ in range(150)]
    # a cloud of near copies of one text: many are linked with few of the others only
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 + i, "  ".join(w) if i % 2 else "\t".join(x.upper() for x in w)))
    rows += [(5, None), (6, ""), (7, " \n"), (None, rows[0][1]), (900, rows[3][1]), (900, rows[3][1]), (901, "A b C d"), (902, "a B c D"), (903, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash")).withColumn("sig", F.lit(1))
    got = sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in near_dup.near_duplicates(docs).collect())
    assert got == brute_components(rows, 85)


def template_cloud(n, pairs, seed=1):
    """Documents of one template that are at 0.80 to each other but for some pairs at 0.864."""
    rng = random.Random(seed)
    word = lambda: f"u{rng.getrandbits(60):x}"
    template = [f"t{i}" for i in range(360)]
    rows = []
    for i in range(n):
        own = [word() for _ in range(40)]
        if i < 2 * pairs and i % 2:
            own[:15] = rows[-1][1][200:215]
        rows.append((i, template[:200] + own + template[200:]))
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in rows]


def test_pairs_within_a_dense_region(spark):
    rows = template_cloud(5200, 200)
    first = dict(rows)
    a, b = shingles(first[0]), shingles(first[1])
    assert 0.86 < len(a & b) / len(a | b) < 0.87 and len(a & shingles(first[2])) / len(a | shingles(first[2])) < 0.81
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i - i % 2 if i < 400 else i for i in range(5200)}


def passage_cloud(n, slots=20, variants=20, seed=5):
    """Documents of one template with passages, each of which more than a hundred have: at 0.80 to each other, at 0.856 where
    six passages or more are the same.  Rows and the component of each."""
    rng = random.Random(seed)
    picks = np.array([[rng.randrange(variants) for _ in range(slots)] for _ in range(n)])
    rows = []
    for i, pick in enumerate(picks):
        words = []
        for s in range(slots):
            words += [f"t{s}x{k}" for k in range(74)] + [f"p{s}v{pick[s]}x{k}" for k in range(5)]
        rows.append((i, " ".join(words)))
    hot = np.zeros((n, slots * variants), np.float32)
    for s in range(slots):
        hot[np.arange(n), s * variants + picks[:, s]] = 1
    same = hot @ hot.T
    low = list(range(n))
    moved = True
    while moved:
        moved = False
        for i, j in zip(*np.nonzero(np.tril(same >= 6, -1)), strict=True):
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                moved = True
    return rows, low, same


def test_pairs_that_share_only_what_many_have(spark):
    rows, want, same = passage_cloud(2400)
    for v, least, most in ((5, 0.846, 0.847), (6, 0.856, 0.857)):
        a, b = (shingles(rows[int(x[0])][1]) for x in np.nonzero(np.tril(same == v, -1)))
        assert least < len(a & b) / len(a | b) < most
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize(("region", "block", "percent"), [(4, 8, 85), (4, 400, 85), (400, 400, 85), (4, 8, 60), (4, 8, 100)])
def test_similar_sets_share_a_bucket_of_the_exact_join(spark, monkeypatch, region, block, percent):
    monkeypatch.setattr(near_dup, "REGION", region)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(7)
    sets = []
    for family in range(4):
        base = [rng.getrandbits(62) for _ in range(100 + 20 * family)]
        for k in range(60):
            own = [rng.getrandbits(62) for _ in range(rng.randint(0, 12))]
            sets.append(set(rng.sample(base, len(base) - rng.randint(0, 20 if k % 2 else 4))) | set(own))
    # at the bound itself, and of all sizes
    for n in (20, 40, 100, 300):
        whole = [rng.getrandbits(62) for _ in range(n)]
        sets += [set(whole), set(whole[: n * percent // 100])]
    named = {near_dup._set_id(x): x for x in (np.array(sorted(x), np.uint64) for x in sets)}
    at, sets = {c: i for i, c in enumerate(named)}, [set(x.tolist()) for x in named.values()]
    rows = spark.createDataFrame([(c, x.tobytes()) for c, x in named.items()], "cid binary, hashes binary")
    prefixes = near_dup._prefixes(rows, percent)
    for groups in (near_dup._groups(prefixes), prefixes.select("cid", "size", F.col("bucket").alias("group"))):
        met, buckets = set(), {}
        for r in near_dup._tiles(groups, percent).collect():
            buckets.setdefault(r.bucket, set()).add(at[bytes(r.cid)])
        for b in buckets.values():
            met |= {(i, j) for i in b for j in b if j < i}
        similar = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
        assert len(similar) >= 4 or percent == 100
        assert similar <= met and len(met) < len(sets) * (len(sets) - 1) // 2
        assert max(map(len, buckets.values()), default=0) <= max(region, 4 * block)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(b"\1", b"\2"), (b"\3", b"\2"), (b"\5", b"\4"), (b"\6", b"\5"), (b"\7", b"\6"), (b"\7", b"\1"), (b"\x09", b"\x08"), (b"\x0a", b"\x0a")]
    got = {bytes(r.a): bytes(r.root) for r in near_dup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\1" for i in range(2, 8)} | {b"\x09": b"\x08"}


def test_hilbert_steps_are_neighbours():
    grid = np.array([(i, j, k) for i in range(4) for j in range(4) for k in range(4)])
    walk = grid[np.argsort(hilbert_index(grid, 2))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:140] = x[100]  # one vector forty times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] + [1.0] * 7), (1080, [None] + [1.0] * 7), (1100, [float("inf")] * 8), (1120, [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("cls", F.lit("clash"))
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 300, 20))
    d = x.astype(np.float64)
    hits = 0
    for q, found in by.items():
        score = d @ d[q]
        order = [i for i in np.lexsort((np.arange(300), -score.round(12))) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        # the search is an approximate one; what it finds has exact scores and stands in exact order
        got_ids = [f[1] for f in found]
        assert got_ids == sorted(got_ids, key=lambda i: (-score[i].round(12), i)) and q not in got_ids
        assert np.allclose([f[2] for f in found], score[got_ids], atol=1e-12, rtol=0)
        hits += len({*got_ids} & {*order})
    assert hits >= 0.95 * 20 * len(by)
    assert nearest.nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    hard = spark.createDataFrame([(-1, None), (-2, ""), (None, "The THE the"), (-3, "unseenword " * 3)], docs.schema)
    rows = docs.unionByName(hard).withColumn("held", F.lit("clash"))
    return [tuple(r) for r in rows.select("doc_id", "text").collect()], pitman_yor.score(rows).collect()


def test_base_scores_are_exact(scored):
    rows, got = scored

    def words(t):
        return [*(t or "").encode().lower().split(), None]

    count = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2:
            count.update(words(t))
    n, v = sum(count.values()), len(count)
    want = sorted((d if d is not None else -99, len(words(t)), sum(count[w] > 0 for w in words(t)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}


def test_the_model_beats_the_base_on_held_out_documents(scored):
    held = [r for r in scored[1] if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    per, names, counts = [], [], []
    for _ in words:
        own = np.sort(rng.choice(2000, rng.integers(1, 8), replace=False)).astype(np.uint32)
        per.append(len(own))
        names.append(own)
        counts.append(rng.integers(1, 200, len(own)).astype(np.uint32))
    s = pitman_yor.Seating(pitman_yor._pack(words, np.array(per, np.uint32), np.concatenate(names), np.concatenate(counts)), 0)
    d = (0.6, 0.6, 0.6)
    for i in range(3):
        s.sweep(s.totals(), d, i)
        assert (s.tables <= s.count).all() and (s.tables >= 1).all()
    t = s.totals()
    for name in (names[0][0], np.uint32(1999), np.uint32(70000)):
        all_words = np.append(words, np.uint64(12345))  # the last one is unknown
        context = np.full(len(all_words), name, np.uint32)
        assert math.isclose(s.probability(t, d, s.find(all_words, context), context).sum(), 1.0, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = pitman_yor.score(docs, held=F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0)
    assert pitman_yor.score(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(70)
    hard = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src1", 0), (None, docs.first().text, "en", None, 1)], docs.schema)
    docs = docs.unionByName(hard).unionByName(docs.limit(2)).withColumn("score", F.lit("clash")).withColumn("_n", F.lit(1))
    columns = list(corpus_pipeline.COLUMNS)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SF).checkpoint()
        seen.append((name, before, docs.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "MinHash near-dedup":
            ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids))
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert len(set(brute_components(kept, 80))) == len(kept)
        if name == "language ID":
            assert before - docs.count() == 2  # null and empty
    assert all(after > 0 for _, _, after in seen)
    by = {}
    for r in docs.collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in items) <= 2048 for items in by.values())


def _truth(vectors, queries, k=20):
    """The k nearest of each query by brute force, ties to the smaller id."""
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        score = m @ np.array(vectors[q], np.float64)
        score[ids == q] = -np.inf
        out[q] = ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]].tolist()
    return out


def test_nearest_of_many_blocks(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(400, 32))
    points = (centres[rng.integers(0, 400, 20_000)] + 0.15 * rng.normal(size=(20_000, 32))).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": list(points)}), "vec_id long, embedding array<float>")
    lengths = []
    plain = nearest._block_length
    try:
        nearest._block_length = lambda *a: lengths.append(plain(*a)) or lengths[-1]
        got = nearest.nearest(df.repartition(4), F.col("vec_id") % 200 == 0).collect()
    finally:
        nearest._block_length = plain
    assert lengths[0] < 20_000 / 20  # far from a full comparison
    want = _truth(dict(enumerate(points)), range(0, 20_000, 200))
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(x) == 20 for x in found.values()) and len(found) == 100
    assert np.mean([len({*found[q]} & {*want[q]}) / 20 for q in want]) >= 0.9


def test_nearest_with_repeated_and_conflicting_ids(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(60)}
    rows = [(i, v) for i, v in vectors.items()] + [(0, vectors[0])] * 2 + [(20, vectors[20])]
    low, high = sorted((vectors[7], rng.normal(size=8).astype(np.float32).tolist()))
    rows = [r for r in rows if r[0] != 7] + [(7, high), (7, low), (7, high)]
    vectors[7] = low
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got) == 60
    want = _truth(vectors, (0, 20, 40))
    found = {q: {r.vec_id for r in got if r.query_id == q} for q in want}
    assert np.mean([len(found[q] & {*want[q]}) / 20 for q in want]) >= 0.9
    by_hand = {(r.query_id, r.vec_id): r.score for r in got}
    for (q, v), score in by_hand.items():
        total = 0.0
        for x, y in zip(vectors[v], vectors[q], strict=True):
            total += float(np.float32(x)) * float(np.float32(y))
        assert score == total
