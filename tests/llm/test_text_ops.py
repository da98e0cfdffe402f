"""Line quality, packing, language, wrappers: the parts that need no Spark, and each operator on hard rows."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language_id, line_quality, packing, sql, wrapper

SF = "/root/testdata/sf0.001"

TEXTS = [None, "", " \n\t", "one two three.", "a b c a b c a b c.\n" * 20, "x\u00a0y z. " * 30 + "\n\n" + "x\u00a0y z. ", "Home | About | More | News | x.\n" * 3 + "Good text here is long enough. " * 30, "WOW!! SO!! BIG!! TEXT!!\n" * 20, "é# $ & 😀 plain words here, fine. " * 20, "no marks at all " * 40]


def test_line_quality_equals_its_sql(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("t", F.lit(2))
    got = line_quality.line_quality(docs)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, con.execute(sql.OP3).fetchall()))
    assert line_quality.line_quality(docs.limit(0)).count() == 0


def test_lines_are_removed():
    good = [" ".join(f"w{i}x{k}" for k in range(8)) + "." for i in range(12)]
    *_, failed, left, clean = line_quality.judge("\n".join([*good, "Home | News | Login | Help", "We use cookies. Read our cookie policy."]))
    assert not failed and clean == "\n".join(good) and left == len(clean.split())


def test_repeated_words_count_positions():
    assert line_quality.judge("a b c x a b c")[4] == 6
    assert line_quality.judge("a a a a")[4] == 4
    assert line_quality.judge("a b")[4] == 0


HARD = ["Don't can't WE'LL x's", "İstanbul ΑΣ Σας", "e\u0301 n\u0303o", "½ ² 3.14 １２", "a\x1cb\x85c\u00a0d", "<|endoftext|> <|x|>", "中文 😀 ٣", "", "ÀÉÎ ß ŉ ǅ ɐ", "foo_bar--baz !!! ###", "\r\n\tx\x0by", "日本語Ωmega'd"]


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(packing.default_tokenizer())
    words = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 40").fetchall()]
    texts = HARD + words + HARD
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def bins_of(rows: np.ndarray, lengths: list[int]) -> dict[int, list[tuple[int, int]]]:
    key, count, bins = rows[:, 0] * (1 << 48) + rows[:, 1], Counter(), {}
    for v in lengths:
        length, first, k, sequence, offset = rows[np.searchsorted(key, v * (1 << 48) + count[v], side="right") - 1]
        assert length == v
        within = count[v] - first
        count[v] += 1
        bins.setdefault(int(sequence + within // k), []).append((int(offset + within % k * v), v))
    return bins


def least(lengths: tuple[int, ...], capacity: int) -> int:
    best = len(lengths)

    def go(i: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[i]:
                at = rooms.index(r)
                go(i + 1, rooms[:at] + (r - lengths[i],) + rooms[at + 1 :])
        go(i + 1, rooms + (capacity - lengths[i],))

    go(0, ())
    return best


def test_plans_are_gapless_and_reductions_lose_nothing():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.randint(4, 20)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = bins_of(packing.plan(Counter(lengths), capacity), lengths)
        assert sorted(bins) == list(range(len(bins)))
        for items in bins.values():
            at = 0
            for offset, v in sorted(items):
                assert offset == at
                at += v
            assert at <= capacity
        # what is fixed is part of an optimal packing
        count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        fixed = sum(n for n, _ in packing.reduce_instance(count, capacity))
        rest = tuple(itertools.chain.from_iterable([v] * int(count[v]) for v in range(capacity, 0, -1)))
        assert fixed + least(rest, capacity) == least(tuple(lengths), capacity)


def test_packing_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "a b"), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(packing.pieces(docs)).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * 5001
    assert sorted(r.length for r in got if r.doc_id in (1, 2)) == [1, 1]
    assert {r.ids_crc32 for r in got if r.doc_id in (1, 2)} == {zlib.crc32(b"\0\0\0\0")}
    by = {}
    for r in got:
        assert r.start == r.piece * packing.CAPACITY
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_packing_writes_the_pieces_only(spark, monkeypatch):
    # each table that is kept is one more file a task, which on many partitions is most of what there is to do
    written = []
    monkeypatch.setattr(packing, "cut", lambda df, own=packing.cut: written.append(df.columns) or own(df))
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(200)], "doc_id long, text string")
    got = packing.pack(packing.pieces(docs)).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 200
    assert written == [["doc_id", "piece", "start", "length", "ids_crc32"]]


@pytest.mark.parametrize("most", [0, 10**6])
def test_packing_is_the_same_by_broadcast_or_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "SHARE", 7, raising=True)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", most, raising=True)
    docs = spark.createDataFrame([(i, "word " * (i % 5)) for i in range(300)], "doc_id long, text string")
    got = packing.pack(packing.pieces(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == 300 and len(by) == 1
    assert sum(n for _, n in by[got[0].sequence_id]) == 900
    for items in by.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(items))]
        assert [at for at, _ in sorted(items)] == ends[:-1]


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    hard = spark.createDataFrame([(-1, None, "en"), (-2, "12 !", None), (-3, "", "fr"), (-4, "中文字符" * 50, None), (-5, "the and of that " * 20000, None)], docs.schema)
    both = docs.unionByName(hard).unionByName(docs.limit(1)).withColumn("score", F.lit("clash"))
    return {r.doc_id: r for r in language_id.identify(both, keep=["doc_id", "lang", "text"]).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()}


def test_language_accuracy_on_documents_not_learnt_from(judged):
    held = [r for r in judged.values() if r.held and r.lang and r.text and len(r.text) > 20]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in judged.values())
    assert sum(r.rejected for r in judged.values() if r.doc_id >= 0) <= 1


def test_language_hard_rows(judged):
    assert all((judged[i].lang_pred, judged[i].score, judged[i].rejected) == ("und", 0.0, True) for i in (-1, -2, -3))
    assert judged[-4].rejected and judged[-4].lang_pred != "und"
    assert judged[-5].lang_pred == "en"


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs).first().lang_pred == "und"
    assert language_id.identify(docs.limit(0)).count() == 0


def test_models_are_distributions():
    table = language_id._letters()
    counts = {}
    for lang, t in (("a", "abab abc cab "), ("b", "xyzzy yxz zzz ")):
        code, begin, _ = language_id._codes([t * 5], table)
        counts[lang] = np.unique(language_id._grams(code, begin, 4), return_counts=True)
    m = language_id._kneser_ney(counts, ["a", "b"])
    alphabet = [ord(c) for c in " abcxyz"]
    for context in ((97, 98, 97), (120, 121, 122), (99, 99, 99)):
        head = sum(c << (16 * (3 - i)) for i, c in enumerate(context))
        grams = np.array([head | c for c in alphabet], np.uint64)
        # one share is left for characters that were never seen
        total = np.exp(m._logp(grams, 4)).sum(axis=0)
        assert (total <= 1 + 1e-5).all() and (total > 0.75).all()


PAGE = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav><!-- c --><div class="ad">Buy {n}</div><article><h1>Head {n} &amp; more</h1><p><b>First   part {n}.<br><p>Second\nline &lt;{n}&gt;.</p><p>Share this page</p></article><div id="comments"><p>Reader {n}</p></div><footer>&copy; site</footer></body></html>'


def host(pages):
    """The finished wrapper of a host's pages."""
    w = None
    for p in sorted(set(pages), key=wrapper._hash):
        new = wrapper.fold(wrapper.parse(p))
        w = new if w is None else wrapper.merge(w, new)
    return wrapper.finished(w)


def texts(pages, w=None):
    w = w or host(pages)
    return [wrapper.extract(wrapper.parse(p), w) for p in pages]


def test_article_only():
    pages = [PAGE.replace("{n}", str(i)) for i in range(6)]
    assert texts(pages)[2] == "Head 2 & more\nFirst part 2.\nSecond line <2>."
    # without an article, constant text of the host is template
    loose = [f"<div><p>Welcome</p><span>Story {i}</span><h2>Part {i}</h2><pre>our imprint</pre></div>" for i in range(6)]
    assert texts(loose)[3] == "Story 3\nPart 3"
    assert texts(loose[:1]) == ["Welcome\nStory 0\nPart 0\nour imprint"]


def test_a_constant_sibling_is_template_wherever_it_stands():
    pages = [f"<div><p>Story {i}</p>" + "".join(f"<p>more {i} {k}</p>" for k in range(i % 3)) + "<p>Follow us on our channel.</p></div>" for i in range(8)]
    assert texts(pages) == ["\n".join([f"Story {i}", *(f"more {i} {k}" for k in range(i % 3))]) for i in range(8)]


def test_order_of_pages_does_not_matter():
    r = random.Random(3)
    pages = ["<div>" + "".join(r.choice(("<p>{}</p>", "<h3>{}</h3>", "<div><p>{}</p><b>x</b></div>")).format(r.choice(("same", "other", str(r.random())))) for _ in range(r.randint(1, 9))) + "</div>" for _ in range(15)]
    want = host(pages)
    for _ in range(5):
        r.shuffle(pages)
        assert host(pages) == want


@pytest.mark.parametrize(
    "html,want",
    [
        ('<body class="right-sidebar single"><article><p>Hello world.</p></article></body>', "Hello world."),
        ('<div class="content-with-sidebar"><h1>T</h1><p>Hello world.</p></div>', "T\nHello world."),
        ('<form id="aspnetForm"><p>Hello world.</p></form>', "Hello world."),
        ("<nav>a</nav><form>Login <label>name</label></form>", ""),
        ('<div class="comments"><p>nice one</p></div>', ""),
        ("<article><p>teaser</p></article><div><p>" + "a long story " * 30 + "</p></div>", "teaser\n" + ("a long story " * 30).strip()),
        ('<div class="has-sidebar"><main><p>yes</p><div class="comments"><article class="comment"><p>no</p></article></div></main><div id="mainSidebar"><article><p>no</p></article></div></div>', "yes"),
        ("<article><p>yes</p></article><p>short</p>", "yes"),
        ("<div>" * 3000 + "deep <b>x</b>" + "</div>" * 10 + " after<nav>no</nav>", "deep x\nafter"),
        ("<div>" * 1500 + "<nav><p>no</p></nav><p>a</p>text<p>b</p>" + "</div>" * 1500 + "end", "a\ntext\nb\nend"),
        ("</div>" * 3000 + "<p>a" * 3000, "\n".join("a" * 3000)),
    ],
)
def test_ancestors_and_depth(html, want):
    assert wrapper.extract(wrapper.parse(html), None) == want
    assert wrapper.fold(wrapper.parse(html))[2] == 1


# Pages with labels: what is article was marked by hand.
LABELLED = [
    ("<div id=page><div class=site-header>Daily {n}</div><div class=crumbs>Home &gt; {n}</div><div class=story><h1>{t}</h1><p>{a}</p><p>Subscribe for more stories.</p><p>{b}</p></div><div class=box>All rights reserved</div></div>", "Home > {n}\n{t}\n{a}\n{b}"),
    ("<main><h1>{t}</h1><div class='share-bar'>share</div><section><p>{a}</p></section><p>{b}</p><ul class=tags><li>Tags:</ul></main><div class='post-comments'><p>first!</p></div>", "{t}\n{a}\n{b}"),
    ("<table><tr><td>Menu<td><h2>{t}</h2><p>{a}<p>{b}<tr><td>Imprint</table>", "{t}\n{a}\n{b}"),
    ("<form action=/ id=form1><div class='wrapper no-ads'><h1>{t}</h1><div>{a}<br>{b}</div><button>Send</button></div></form>", "{t}\n{a} {b}"),
]


@pytest.mark.parametrize("template,want", LABELLED)
def test_labelled_pages(template, want):
    r = random.Random(1)
    rows = [{"n": n, "t": f"Title {n}", **{k: " ".join(r.choice("abcdefg") * r.randint(2, 7) for _ in range(30)) + "." for k in "ab"}} for n in range(12)]
    assert texts([template.format(**x) for x in rows]) == [want.format(**x) for x in rows]


@pytest.mark.parametrize("html,want", [("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>x &unknown; &#65; &eacute;</p", "x &unknown; A é"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<a title='x > y'>t</a>", "t"), ("a<script>if (a<b) x()</script>b", "a\nb"), ("<p hidden>no</p><p>yes</p>", "yes"), ("<<p>>", "<\n>"), ("<!-- never closed", ""), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3")])
def test_broken_markup(html, want):
    assert wrapper.extract(wrapper.parse(html), None) == want


def test_wrappers_of_a_large_host_in_any_partitions(spark):
    rows = [(i, "http://big.example/", f"<div><p>Story {i}</p>" + ("<p>Rare note</p>" if i % 5 == 0 else "") + "<p>Constant</p></div>") for i in range(400)]
    rows += [(1000 + i, f"http://h{i}.example/", "<p>only one</p>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, b = ({r.page_id: r.text for r in wrapper.main_text(pages.repartition(n)).collect()} for n in (1, 7))
    assert a == b and all(a[i] == f"Story {i}" for i in range(400)) and a[1000] == "only one"
    one, two = ({r.host: r.wrapper for r in wrapper.induce(pages.repartition(n).selectExpr("'h' as host", "html")).collect()} for n in (1, 5))
    assert one == two and one["h"].count("[") > 2


def test_pages_hard_rows(spark):
    rows = [(1, "http://a.com/1", None), (2, None, ""), (3, "bad", "<p>x"), (3, "bad", "<p>x"), (4, "http://a.com/2", PAGE.replace("{n}", "long " * 20000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.n_chars, r.text[:9]) for r in wrapper.main_text(pages).collect())
    assert [g[0] for g in got] == [1, 2, 3, 3, 4] and got[:4] == [(1, 0, ""), (2, 0, ""), (3, 1, "x"), (3, 1, "x")] and got[4][1] > 300_000 - 10
    assert wrapper.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["यह एक वाक्य है।", "これは文です。", "هل هذا سؤال؟", "Это предложение."])
def test_sentences_of_other_scripts(line):
    assert line_quality.line_failure(line.encode(), line.encode().split()) is None


@pytest.mark.parametrize("line", ["Alle Rechte vorbehalten.", "© Tous droits réservés.", "Nuestra política de privacidad."])
def test_notices_of_other_languages(line):
    assert line_quality.line_failure(line.encode(), line.encode().split()) == "boilerplate"


def test_long_chunks_are_not_remembered():
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = ["x" * 100_000, "a word", "y" * 300 + " a"]
    assert list(encoder.encode(texts)) == [encoder._slow(t) for t in texts]
    assert list(encoder.encode(["a word"])) == [encoder._slow("a word")]
    assert max(map(len, encoder.known)) <= packing.CACHE_CHARS


def test_remembered_text_is_bounded():
    encoder = packing.Encoder(packing.default_tokenizer())
    first = "the frequent words"
    for at in range(0, 60_000, 2_500):
        texts = [first, " ".join(f"{i:06d}" + "a" * 240 for i in range(at, at + 2_500))]
        got = list(encoder.encode(texts))
        assert got[0] == encoder._slow(first)
        assert sum(map(len, encoder.known)) < 13_000_000
    assert got[1] == encoder._slow(texts[1])
    assert set(first.split()) <= set(encoder.known)


def test_long_texts_are_encoded_a_few_at_a_time(monkeypatch):
    encoder, asked = packing.Encoder(packing.default_tokenizer()), []
    monkeypatch.setattr(encoder, "_learn", lambda chunks, own=encoder._learn: asked.append(sum(map(len, chunks))) or own(chunks))
    texts = [" ".join(f"{k}{i:06d}" for i in range(80_000)) for k in range(3)] + ["", "a b"]
    assert list(encoder.encode(texts)) == [encoder._slow(t) for t in texts]
    assert max(asked) < 1_000_000
    assert list(encoder.encode([])) == []
