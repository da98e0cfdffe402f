from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import feed, revisions

REVS = "id string, rev string, gen long, parent_rev string, seq long, deleted boolean, body string, body_available boolean"


def forest(spark, *rows):
    """Rows (id, rev, parent, seq) or with deleted and body."""
    out = []
    for i, rev, parent, seq, *rest in rows:
        out.append((i, rev, int(rev.split("-")[0]), parent, seq, bool(rest and rest[0]), rest[1] if len(rest) > 1 else "{}", not (len(rest) > 1 and rest[1] is None)))
    return spark.createDataFrame(out, REVS)


def batch(spark, *rows):
    return spark.createDataFrame([(n, i, r, d, "{}", a) for n, (i, r, d, a) in enumerate(rows)], "pos int, id string, rev string, deleted boolean, body string, ancestry array<string>")


def test_skipped_generation_leaves_a_stub(spark):
    r = revisions.replicate(spark.createDataFrame([], REVS), batch(spark, ("d", "1-a", False, ["1-a"])))
    r = revisions.replicate(r, batch(spark, ("d", "3-c", False, ["3-c", "2-b", "1-a"])))
    got = {x.rev: (x.parent_rev, x.body_available) for x in r.collect()}
    assert got == {"1-a": (None, True), "2-b": ("1-a", False), "3-c": ("2-b", True)}
    assert revisions.conflicts(r).count() == 0
    wanted = spark.createDataFrame([("d", "2-b"), ("d", "9-x")], "id string, rev string")
    assert [tuple(x) for x in revisions.revs_diff(wanted, r).collect()] == [("d", ["9-x"])]
    asked = spark.createDataFrame([(0, "d", "2-b")], "pos int, id string, rev string")
    assert revisions.bulk_get(asked, r).first().error == "not_found"
    r = revisions.replicate(r, batch(spark, ("d", "4-d", True, ["4-d", "3-c", "2-b", "1-a"])))
    assert feed.all_docs(revisions.docs(r)).count() == 0


def test_short_history_is_repaired(spark):
    r = revisions.replicate(spark.createDataFrame([], REVS), batch(spark, ("d", "1-a", False, ["1-a"]), ("d", "2-b", False, ["2-b"])))
    assert revisions.conflicts(r).first().conflicts == ["1-a"]
    r = revisions.replicate(r, batch(spark, ("d", "3-c", False, ["3-c", "2-b", "1-a"])))
    assert {x.rev: x.parent_rev for x in r.collect()}["2-b"] == "1-a"
    assert revisions.conflicts(r).count() == 0


def test_known_revision_takes_no_sequence_and_a_late_body_does(spark):
    r = revisions.replicate(spark.createDataFrame([], REVS), batch(spark, ("d", "2-b", False, ["2-b", "1-a"])))
    again = revisions.replicate(r, batch(spark, ("d", "2-b", False, ["2-b", "1-a"])))
    assert sorted(x.seq for x in again.collect()) == [1, 1]
    late = revisions.replicate(r, batch(spark, ("d", "1-a", False, ["1-a"])))
    assert {x.rev: (x.seq, x.body_available) for x in late.collect()} == {"2-b": (1, True), "1-a": (2, True)}


def test_winner_switch(spark):
    rows = [("d", "1-root", None, 1), ("d", "2-z-winner", "1-root", 2), ("d", "2-a-loser", "1-root", 3)]
    r = forest(spark, *rows)
    page = feed.changes(r).collect()
    assert [(x.seq, x.revs) for x in page] == [(3, ["2-z-winner"])]
    r = forest(spark, *rows, ("d", "3-del", "2-z-winner", 4, True))
    assert [(x.seq, x.revs, x.deleted) for x in feed.changes(r, since=3).collect()] == [(4, ["2-a-loser"], False)]
    assert feed.changes(r, since=3, style="all_docs").first().revs == ["2-a-loser", "3-del"]


def test_deleted_winner_only_if_all_leaves_are(spark):
    r = forest(spark, ("d", "1-a", None, 1), ("d", "9-z", "1-a", 2, True), ("d", "2-b", "1-a", 3), ("e", "1-a", None, 4, True))
    assert {x.id: (x.winning_rev, x.deleted) for x in revisions.docs(r).collect()} == {"d": ("2-b", False), "e": ("1-a", True)}


def test_edits_conflict_within_a_batch(spark):
    r = forest(spark, ("d", "1-a", None, 1), ("e", "1-x", None, 2, True))
    edits = spark.createDataFrame([(0, "d", "1-a", False, '{"n":1}'), (1, "d", "1-a", False, '{"n":2}'), (2, "d", None, False, "{}"), (3, "e", None, False, "{}"), (4, "f", None, False, "{}")], "pos int, id string, parent string, deleted boolean, body string")
    after, answer = revisions.apply_edits(r, edits)
    got = {x.pos: (x.status, x.rev and x.rev.split("-")[0]) for x in answer.collect()}
    assert got == {0: ("ok", "2"), 1: ("conflict", None), 2: ("conflict", None), 3: ("ok", "2"), 4: ("ok", "1")}
    assert sorted(x.seq for x in after.collect()) == [1, 2, 3, 4, 5]


def test_compaction_keeps_the_tree(spark):
    r = revisions.compact(forest(spark, ("d", "1-a", None, 1, False, '{"x":1}'), ("d", "2-b", "1-a", 2, False, '{"x":2}')))
    assert {x.rev: (x.body, x.body_available) for x in r.collect()} == {"1-a": ("{}", False), "2-b": ('{"x":2}', True)}


def test_descendants_follow_edges(spark):
    r = forest(spark, ("d", "1-a", None, 1), ("d", "2-b", "1-a", 2), ("d", "3-c", "2-b", 3), ("d", "2-x", "1-a", 4))
    wanted = spark.createDataFrame([("d", "1-a"), ("d", "2-b"), ("d", "7-q")], "id string, rev string")
    got = sorted((x.rev, x.leaf) for x in revisions.descendants(wanted, r).collect())
    assert got == [("1-a", "2-x"), ("1-a", "3-c"), ("2-b", "3-c")]


def test_long_runs_of_chunks_do_not_stop_a_filtered_feed(spark):
    rows, seq = [], 0
    for block in range(4):
        for i in range(45):
            seq += 1
            rows.append((f"leaf{block}-{i}", seq, "leaf"))
        if block < 3:
            seq += 1
            rows.append((f"note{block}", seq, "note"))
    r = spark.createDataFrame([(i, "1-a", 1, None, s, False, "{}", True, t) for i, s, t in rows], REVS + ", type string")
    current = revisions.docs(r)
    match = F.col("type") != "leaf"
    first = feed.changes(r, limit=2, match=match)
    assert [x.seq for x in first.collect()] == [46, 92]
    assert tuple(feed.page_end(first, current, limit=2, narrow=True).first()) == (92, 91)
    second = feed.changes(r, since=92, limit=2, match=match)
    assert [x.seq for x in second.collect()] == [138]
    assert tuple(feed.page_end(second, current, limit=2, narrow=True).first()) == (183, 0)
    assert feed.changes(r, since=183, limit=2, match=match).count() == 0


def test_empty_tables(spark):
    r = spark.createDataFrame([], REVS)
    assert revisions.docs(r).count() == revisions.conflicts(r).count() == feed.changes(r).count() == 0
    assert tuple(feed.info(revisions.docs(r)).first()) == (0, 0, 0)
