"""The character models against plain Kneser-Ney, and the sample that they are fitted on."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language_id


def plain_codes(text):
    """Letters lower-cased, all else one space, after three spaces of history and the one that each text begins with."""
    out = "    "
    for c in text:
        c = c.lower() if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out += c
    return out


def plain_models(texts, alphabet):
    grams = Counter(code[i - 3 : i + 1] for code in map(plain_codes, texts) for i in range(3, len(code)))
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    totals = {k: defaultdict(lambda: [0, 0]) for k in levels}
    for k, table in levels.items():
        for g, n in table.items():
            totals[k][g[:-1]][0] += n
            totals[k][g[:-1]][1] += 1

    def p(gram, k):
        if k == 0:
            return 1 / alphabet
        g = gram[4 - k :]
        below = p(gram, k - 1)
        if g[:-1] not in totals[k]:
            return below
        total, kinds = totals[k][g[:-1]]
        return max(levels[k].get(g, 0) - 0.75, 0) / total + 0.75 * kinds / total * below

    return lambda gram: p(gram, 4)


def test_models_are_plain_kneser_ney():
    texts = {"a": ["the cat sat on the mat", "that hat is the cat's"], "b": ["die katze sass", "das ist die matte der katze ß"]}
    table = language_id._letters()
    counts = {}
    for lang, ts in texts.items():
        code, begin, _ = language_id._codes(ts, table)
        counts[lang] = np.unique(language_id._grams(code, begin, 4), return_counts=True)
    m = language_id._kneser_ney(counts, ["a", "b"])
    alphabet = len({c for ts in texts.values() for t in ts for c in plain_codes(t)}) + 1
    plain = [plain_models(texts[x], alphabet) for x in "ab"]
    for text in ("the cat", "die matte zzz", "unseen words: qxz", "Ängste"):
        own, _, n, _ = m.entropies([text], table)
        code = plain_codes(text)
        for i, p in enumerate(plain):
            want = -sum(math.log(p(code[k - 3 : k + 1])) for k in range(3, len(code))) / (len(code) - 3)
            assert n[0] == len(code) - 3 and own[0, i] == pytest.approx(want, rel=1e-5)


def test_a_language_of_one_repeated_text_is_learnt(spark):
    rows = [(i, "zorp blix quando vexil marno trub", "xx") for i in range(3000)] + [(10_000 + i, f"the end of the story number {i} and that of the other " * 2, "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    models = language_id.fit(docs.select("lang", "text"))
    assert models.languages == ["en", "xx"]
    got = {r.lang: r.lang_pred for r in language_id.predict_frame(docs, models, ["lang"]).select("lang", "lang_pred").distinct().collect()}
    assert got == {"en": "en", "xx": "xx"}


def test_more_labels_than_languages(spark):
    rows = [("en", f"the end of the story {i} and that of the other") for i in range(40)] + [(f"junk{i}", f"label {i} text") for i in range(language_id.LANGUAGES + 40)]
    models = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(models.languages) == language_id.LANGUAGES and "en" in models.languages


def test_the_sample_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CHARS", 4000)
    rows = [("en", f"{i} " + "the end of that " * 40) for i in range(50)] + [("de", "das ende von diesem " * 5000)]
    models = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert models.languages == ["de", "en"]


def test_equal_languages_go_to_the_smaller_name(spark):
    rows = [(x, f"same text {i} for both of them") for x in ("bb", "aa") for i in range(20)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = language_id.predict_frame(df, language_id.fit(df), ["lang"]).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in got] == ["aa"]


def test_a_text_of_two_known_languages_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language_id.fit(docs.select("lang", "text"))
    part = lambda x: docs.where((F.col("lang") == x) & (F.length("text") > 900)).limit(30).select(F.substring("text", 1, 400).alias("t"), F.monotonically_increasing_id().alias("n"))
    a, b = part("fr").collect(), part("en").collect()
    both = spark.createDataFrame([(x.t + " " + y.t,) for x, y in zip(a, b, strict=True)], "text string")
    assert language_id.predict_frame(both, models, ["text"]).where("rejected").count() <= 1
