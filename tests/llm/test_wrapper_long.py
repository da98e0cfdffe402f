"""Wrappers of pages with very many siblings are aligned as well as those with few."""

from __future__ import annotations

import random

from palimpsest.llm import wrapper


def test_long_lists_align_as_short_ones(monkeypatch):
    r = random.Random(5)

    def tree(depth):
        return [r.choice("abc"), r.choice(("", "", "s", "t", "u", "v")), 1, [tree(depth - 1) for _ in range(r.randint(0, 3))] if depth else []]

    for _ in range(60):
        xs, ys = ([tree(2) for _ in range(r.randint(0, 14))] for _ in range(2))
        monkeypatch.setattr(wrapper, "MATCH_CELLS", 40_000)
        want = wrapper.align(xs, ys)
        monkeypatch.setattr(wrapper, "MATCH_CELLS", -1)
        assert wrapper.align(xs, ys) == want


def test_a_block_that_moves_does_not_unpair_the_others():
    rows = [x for i in range(150) for x in (f"<h3>Label {i}</h3>", "<p>{n} " + str(i) + "</p>")]
    first, last = ["<pre>moved</pre>", *rows], [*rows, "<pre>moved</pre>"]
    pages = ["<div>" + "".join(first if n % 2 else last).replace("{n}", f"story {n}") + "</div>" for n in range(6)]
    w = None
    for p in pages:
        new = wrapper.fold(wrapper.parse(p))
        w = new if w is None else wrapper.merge(w, new)
    got = wrapper.extract(wrapper.parse(pages[0]), wrapper.finished(w)).split("\n")
    assert [x for x in got if x != "moved"] == [f"story 0 {i}" for i in range(150)]


def test_alignment_is_the_best_there_is():
    r = random.Random(9)

    def tree(depth):
        return [r.choice("ab"), r.choice(("", "", "s", "t", "u")), 1, [tree(depth - 1) for _ in range(r.randint(0, 2))] if depth else []]

    def once(nodes, into):
        for n in nodes:
            into[n[1]] = into.get(n[1], 0) + 1
            once(n[3], into)
        return into

    for _ in range(80):
        xs, ys = ([tree(2) for _ in range(r.randint(0, 5))] for _ in range(2))
        ours, theirs = once(xs, {}), once(ys, {})
        shared = {t for t in ours if t and ours[t] == 1 and theirs.get(t) == 1}

        def common(a, b):
            if a[0] != b[0]:
                return 0
            return 1 + wrapper.SAME_TEXT * (a[1] in shared and a[1] == b[1]) + best(a[3], b[3])

        def best(a, b):
            if not a or not b:
                return 0
            return max(best(a[:-1], b), best(a, b[:-1]), best(a[:-1], b[:-1]) + common(a[-1], b[-1]))

        pairs = [(i, j) for i, j in wrapper.align(xs, ys) if i is not None and j is not None]
        assert sum(common(xs[i], ys[j]) for i, j in pairs) == best(xs, ys)


def test_long_tables_of_different_rows_are_matched_in_time():
    a, b = ("<table>" + "".join(f"<tr><td>{i * 7}<td>x<td>{i + n}" for i in range(4000)) + "</table>" for n in (0, 9))
    assert wrapper.merge(*(wrapper.fold(wrapper.parse(x)) for x in (a, b)))[2] == 2
