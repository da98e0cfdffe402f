"""Every stage of the pipeline against a plain version of it, on what the stage before it kept."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import language_id, line_quality, packing, sql

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out, as lists of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("doc_id = 3").first().text
    hard = spark.createDataFrame([(None, text, "en", None, 1), (None, text + " end", "en", "src1", 1), (None, "no copy of this. " * 30, "en", "src2", 1), (-1, None, None, None, None), (7, text + "\nMore of it.", "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(hard).unionByName(docs.where("doc_id < 3"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        folder = f"{tmp_path_factory.mktemp('stage')}/rows"
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out[name] = (before, docs.columns, [tuple(r) for r in docs.collect()])
    return out


def test_language(spark, stages):
    before, _, after = stages["language ID"]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame(before, schema)
    models = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))).select("lang", "text"))
    table = language_id._letters()
    want = Counter()
    for row in before:
        own, part, n, has = models.entropies([row[1] or ""], table)
        best = own.argmin(axis=1)
        if has[0] and part[0] <= models.bound(n, best)[0]:
            want[(row[0], row[1], row[2] or models.languages[best[0]], *row[3:])] += 1
    assert Counter(after) == want and len(after) >= len(before) - 3


def test_quality(stages):
    before, _, after = stages["quality rules"]
    want = Counter()
    for doc_id, text, lang, source, _ in before:
        n, *_, failed, left, clean = line_quality.judge(text)
        if not failed and 100 * left >= line_quality.LEAST_LEFT * n:
            want[doc_id, clean, lang, source, len(clean)] += 1
    assert Counter(after) == want


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup(stages):
    before, _, after = stages["MinHash near-dedup"]
    sets = [shingles(r[1]) for r in before]
    top = list(range(len(before)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(before):
        groups.setdefault(find(i), []).append(r)
    assert len(after) == len(groups)
    ids = Counter(r[0] for r in after)
    for rows in groups.values():
        named = [r[0] for r in rows if r[0] is not None]
        if named:
            assert ids[min(named)] == 1
    assert ids[None] == sum(all(r[0] is None for r in rows) for rows in groups.values())
    assert Counter(after) <= Counter(before)


def test_mixing(stages):
    before, _, after = stages["mixing sources"]
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into d values (?, ?, ?, ?, ?)", before)
    by_text = Counter((r[0], r[1]) for r in after)
    rows = con.execute(f"WITH {sql.mix_ctes('d')} SELECT doc_id, size, taken, source_size, target FROM mixed WHERE doc_id IS NOT NULL").fetchall()
    if None not in {r[0] for r in before}:
        for doc_id, size, taken, _, _ in rows:
            copies = sum(n for (d, _), n in by_text.items() if d == doc_id)
            assert copies == (int(taken / size + 0.5) if size else 0)
    # the words of each source come near its target
    targets = {r[3]: r[4] for r in rows}
    size = lambda t: len(t.split())
    had, has = Counter(), Counter()
    for r in before:
        had[r[3]] += size(r[1])
    for r in after:
        has[r[3]] += size(r[1])
    assert set(after) <= set(before) and max(by_text.values()) <= 3
    for source, n in had.items():
        longest = max(size(r[1]) for r in before if r[3] == source)
        assert abs(has[source] - targets.get(n, has[source])) <= longest + 64


def test_packing(stages):
    before, columns, after = stages["best-fit packing"]
    encoder = packing.Encoder(packing.default_tokenizer())
    want = Counter()
    for row in before:
        ids = np.append(np.array(encoder.tokenizer.encode(row[1] or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[row[0], k, a, len(part), zlib.crc32(part.tobytes())] += 1
    at = [columns.index(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    assert Counter(tuple(r[i] for i in at) for r in after) == want
    lines = {}
    for r in after:
        lines.setdefault(r[columns.index("sequence_id")], []).append((r[columns.index("offset")], r[columns.index("length")]))
    for items in lines.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert STAGES[name](spark, docs, SF).count() == 0
