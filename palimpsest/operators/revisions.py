"""Revision forests: leaves, winners, conflicts, histories, replication.

``revs`` has a row per revision: id, rev, gen, parent_rev, seq, deleted, body_available and whatever else travels along.
Everything is a join or an aggregate on (id, rev) or id, so a table that is bucketed or partitioned by id needs no further
shuffle for a chain of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rev_generation
from ..session import cut, numbered


def leaves(revs: DataFrame) -> DataFrame:
    """Revisions that no other names as its parent."""
    parents = revs.where(F.col("parent_rev").isNotNull()).select("id", F.col("parent_rev").alias("rev"))
    return revs.join(parents, ["id", "rev"], "left_anti")


def inner_revisions(revs: DataFrame) -> DataFrame:
    """The others: revisions with a child."""
    parents = revs.where(F.col("parent_rev").isNotNull()).select("id", F.col("parent_rev").alias("rev"))
    return revs.join(parents, ["id", "rev"], "left_semi")


def orphans(revs: DataFrame) -> DataFrame:
    """Revisions whose parent is not there, or that should have one and name none."""
    known = revs.select("id", F.col("rev").alias("parent_rev"))
    return revs.where(F.col("parent_rev").isNotNull()).join(known, ["id", "parent_rev"], "left_anti").select(revs.columns).unionByName(revs.where(F.col("parent_rev").isNull() & (F.col("gen") > 1)))


def precedence() -> Column:
    """The winner has the highest: live before deleted, then generation, then revision by code point."""
    return F.struct((~F.col("deleted")).alias("live"), F.col("gen"), F.col("rev"))


def docs(revs: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(id, winning_rev, deleted, updated_seq): the winner among the leaves, at the document's latest sequence."""
    best = F.max_by(F.struct("rev", "deleted"), precedence()).alias("w")
    winners = leaves(revs).groupBy("id").agg(best)
    latest = (changes if changes is not None else revs).groupBy("id").agg(F.max("seq").alias("updated_seq"))
    return winners.join(latest, "id").select("id", F.col("w.rev").alias("winning_rev"), F.col("w.deleted").alias("deleted"), "updated_seq")


def winners(revs: DataFrame) -> DataFrame:
    """The winning revisions with all their columns."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*(F.col(f"_p.{c}").desc() for c in ("live", "gen", "rev"))))
    return leaves(revs).withColumn("_p", precedence()).withColumn("_n", rank).where("_n = 1").drop("_p", "_n")


def conflicts(revs: DataFrame) -> DataFrame:
    """(id, conflicts): live leaves beside the winner, sorted; documents without any have no row."""
    tops = leaves(revs)
    best = tops.groupBy("id").agg(F.max_by("rev", precedence()).alias("winning_rev"))
    others = tops.join(best, "id").where((F.col("rev") != F.col("winning_rev")) & ~F.col("deleted"))
    return others.groupBy("id").agg(F.sort_array(F.collect_list("rev")).alias("conflicts"))


def revs_diff(wanted: DataFrame, revs: DataFrame) -> DataFrame:
    """(id, missing) of wanted (id, rev) that are not known, not even as stubs; ids that miss nothing have no row."""
    gone = wanted.distinct().join(revs.select("id", "rev"), ["id", "rev"], "left_anti")
    return gone.groupBy("id").agg(F.sort_array(F.collect_list("rev")).alias("missing"))


def bulk_get(requests: DataFrame, revs: DataFrame) -> DataFrame:
    """requests (pos, id, rev) with what was found: rows in the order and number of the requests.

    Without a rev the winner is meant.  ``error`` is ``not_found`` for what is unknown, a stub, or a deleted winner."""
    best = docs(revs).where(~F.col("deleted")).select("id", "winning_rev")
    asked = requests.join(best, "id", "left").withColumn("rev", F.coalesce("rev", "winning_rev")).drop("winning_rev")
    have = revs.where("body_available").select("id", "rev", "deleted", F.col("body").alias("doc"))
    got = asked.join(have, ["id", "rev"], "left")
    return got.select("pos", "id", "rev", "deleted", "doc", F.when(F.col("doc").isNull(), F.lit("not_found")).alias("error")).orderBy("pos")


def descendants(wanted: DataFrame, revs: DataFrame) -> DataFrame:
    """(id, rev, leaf) with the leaves that come after each wanted revision, itself if it is one.

    Every leaf is carried up to its ancestors by jumps that double each round, so a chain takes as many rounds as its length
    has bits; the rows are one for each leaf and ancestor.  What is not known has no row."""
    own = leaves(revs).select("id", F.col("rev").alias("leaf"), F.col("rev").alias("at"))
    jump = cut(revs.where(F.col("parent_rev").isNotNull()).select("id", F.col("rev").alias("at"), F.col("parent_rev").alias("up")))
    reached = cut(own)
    while not jump.isEmpty():
        # ancestors within 2^k - 1 are known; those as far again above them follow
        reached = cut(reached.unionByName(reached.join(jump, ["id", "at"]).select("id", "leaf", F.col("up").alias("at"))))
        far = jump.select("id", F.col("at").alias("up"), F.col("up").alias("_far"))
        jump = cut(jump.join(far, ["id", "up"]).select("id", "at", F.col("_far").alias("up")))
    known = revs.select("id", "rev")
    asked = wanted.select("id", "rev").distinct().join(known, ["id", "rev"], "left_semi")
    return asked.join(reached.select("id", F.col("at").alias("rev"), "leaf"), ["id", "rev"])


def link_ancestors(arrived: DataFrame) -> DataFrame:
    """Edges that histories tell of: (id, rev, parent_rev, stub) of arrived (id, seq, ancestry) where ancestry lists the
    revision and its ancestors.  A parent is the first that any history names, by sequence; what no row brings itself is
    a stub, known by name only."""
    steps = arrived.select("id", "seq", F.posexplode("ancestry").alias("p", "rev"), "ancestry")
    steps = steps.withColumn("parent", F.try_element_at("ancestry", (F.col("p") + 2).cast("int")))
    # the first named parent by sequence; a null does not replace it
    linked = steps.groupBy("id", "rev").agg(F.min(F.when(F.col("parent").isNotNull(), F.struct("seq", "parent"))).alias("m"), F.max((F.col("p") == 0).cast("int")).alias("own"), F.min("seq").alias("seq"))
    return linked.select("id", "rev", F.col("m.parent").alias("parent_rev"), (F.col("own") == 0).alias("stub"), "seq")


def replicate(revs: DataFrame, batch: DataFrame) -> DataFrame:
    """``revs`` after a replicated batch (pos, id, rev, deleted, body, ancestry): new_edits=false.

    A revision that is there with its body is left alone and takes no sequence; a late body fills its stub at a new one;
    histories add stubs and fill missing parents.  Batch order gives the sequences."""
    good = batch.where(rev_generation(F.col("rev")).isNotNull())
    first = good.withColumn("_n", F.row_number().over(Window.partitionBy("id", "rev").orderBy("pos"))).where("_n = 1").drop("_n")
    new = first.join(revs.where("body_available").select("id", "rev"), ["id", "rev"], "left_anti")
    last = revs.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    placed = numbered(new, "_k", "pos", "id", "rev", first=1).join(F.broadcast(last)).withColumn("seq", F.col("last") + F.col("_k"))
    brought = placed.select("id", "rev", "seq", "deleted", "body", "ancestry")
    edges = link_ancestors(brought.select("id", "seq", "ancestry")).select("id", "rev", F.col("parent_rev").alias("new_parent"), F.col("seq").alias("edge_seq"))
    named = edges.join(brought.drop("ancestry"), ["id", "rev"], "left")
    old = revs.select("id", "rev", F.col("parent_rev").alias("old_parent"), F.col("seq").alias("old_seq"), F.col("deleted").alias("old_deleted"), F.col("body").alias("old_body"), F.col("body_available").alias("old_available"))
    merged = old.join(named, ["id", "rev"], "full")
    return merged.select(
        "id",
        "rev",
        rev_generation(F.col("rev")).alias("gen"),
        F.coalesce("old_parent", "new_parent").alias("parent_rev"),
        F.coalesce("seq", "old_seq", "edge_seq").alias("seq"),
        F.coalesce("deleted", "old_deleted", F.lit(False)).alias("deleted"),
        F.coalesce("body", "old_body", F.lit("{}")).alias("body"),
        (F.col("body").isNotNull() | F.coalesce("old_available", F.lit(False))).alias("body_available"),
    )


def check_edits(edits: DataFrame, revs: DataFrame) -> DataFrame:
    """Local edits (pos, id, parent, deleted, body) against the forest: each row with ``parent``, ``gen`` and ``status``.

    An edit must name a current leaf as its parent.  Without one it is new, or follows a deleted winner; on a live document
    it is a conflict.  Of several edits of one parent in a batch the first is accepted."""
    tops = leaves(revs).select("id", F.col("rev").alias("parent"), F.lit(True).alias("_leaf"))
    best = docs(revs).select("id", "winning_rev", F.col("deleted").alias("_gone"))
    asked = edits.join(best, "id", "left").join(tops, ["id", "parent"], "left")
    fits = F.when(F.col("parent").isNotNull(), F.coalesce("_leaf", F.lit(False))).otherwise(F.coalesce("_gone", F.lit(True)))
    asked = asked.withColumn("_fits", fits).withColumn("parent", F.coalesce("parent", F.when(F.col("_gone"), F.col("winning_rev"))))
    turn = F.row_number().over(Window.partitionBy("id", "parent", "_fits").orderBy("pos"))
    status = F.when(F.col("_fits") & (turn == 1), "ok").otherwise("conflict")
    return asked.withColumn("status", status).withColumn("gen", F.coalesce(rev_generation(F.col("parent")), F.lit(0)) + 1).drop("_fits", "_leaf", "_gone", "winning_rev")


def apply_edits(revs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``revs`` after local edits, and the answer (pos, id, rev, status).  ``edits`` as for check_edits, body in JSON."""
    from ..functions.hashing import revision_hash, stable_body

    judged = check_edits(edits, revs)
    rev = F.concat(F.col("gen").cast("string"), F.lit("-"), revision_hash(stable_body("body"), F.col("parent")))
    judged = judged.withColumn("rev", F.when(F.col("status") == "ok", rev))
    last = revs.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    taken = numbered(judged.where("status = 'ok'"), "_k", "pos", "id", first=1).join(F.broadcast(last))
    new = taken.select("id", "rev", F.col("gen").cast("bigint").alias("gen"), F.col("parent").alias("parent_rev"), (F.col("last") + F.col("_k")).alias("seq"), "deleted", "body", F.lit(True).alias("body_available"))
    return revs.select(new.columns).unionByName(new), judged.select("pos", "id", "rev", "status")


def compact(revs: DataFrame) -> DataFrame:
    """Bodies of revisions with children are dropped; the tree stays, so they are still known."""
    parents = revs.where(F.col("parent_rev").isNotNull()).select("id", F.col("parent_rev").alias("rev")).distinct().withColumn("_inner", F.lit(True))
    marked = revs.join(parents, ["id", "rev"], "left")
    inner = F.coalesce("_inner", F.lit(False))
    return marked.withColumn("body", F.when(inner, F.lit("{}")).otherwise(F.col("body"))).withColumn("body_available", F.col("body_available") & ~inner).select(revs.columns)


def archive(revs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hot, archived): leaves, and everything before them; reads are the union of both."""
    return leaves(revs), inner_revisions(revs)


def compact_changes(changes: DataFrame, current: DataFrame) -> DataFrame:
    """One row per document: its latest sequence with the winner of ``current`` (docs)."""
    latest = changes.groupBy("id").agg(F.max("seq").alias("seq"))
    return latest.join(current, "id").select("seq", "id", F.col("winning_rev").alias("rev"), "deleted")


#: Fields of a public document that the store says, whatever a body has under their names.
PUBLIC_FIELDS = ("_id", "_rev", "_deleted", "_conflicts", "_revisions")


def public_doc(row: DataFrame, with_conflicts: DataFrame | None = None, history: bool = False) -> DataFrame:
    """(id, doc) with doc as JSON: _id, _rev, _deleted only if so, _conflicts only if there are any, with ``history`` also
    _revisions from the column of that name (revisions, the newest first) where it has any; then the body's other fields."""
    joined = row.join(with_conflicts, "id", "left") if with_conflicts is not None else row.withColumn("conflicts", F.lit(None).cast("array<string>"))
    fields = [F.col("id").alias("_id"), F.col("rev").alias("_rev"), F.when(F.col("deleted"), F.lit(True)).alias("_deleted"), F.when(F.size("conflicts") > 0, F.col("conflicts")).alias("_conflicts")]
    if history:
        ids = F.transform("history", lambda r: F.regexp_extract(r, r"^\d+-(.+)$", 1))
        fields.append(F.when(F.size("history") > 0, F.struct(rev_generation(F.get("history", 0)).alias("start"), ids.alias("ids"))).alias("_revisions"))
    head = F.to_json(F.struct(*fields))
    rest = F.to_json(F.map_filter(F.from_json("body", "map<string,variant>"), lambda k, v: ~k.isin(*PUBLIC_FIELDS)))
    whole = F.when(F.length(rest) > 2, F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(","), F.substring(rest, 2, 1 << 30))).otherwise(F.col("_head"))
    return joined.withColumn("_head", head).select("id", whole.alias("doc"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
