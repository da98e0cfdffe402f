"""Documents that are not replicated: consumers' own checkpoints, each with one revision that guards its updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import local_revision, stable_body


def write_local(store: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``store`` (id, rev, body) after writes (pos, id, rev, body, deleted), and the answer (pos, id, rev, status).

    A write must name the revision that is there, or none where there is none; of several for one id in a batch the first
    is taken.  A deletion removes the row."""
    have = store.select("id", F.col("rev").alias("_have"))
    asked = writes.join(have, "id", "left")
    turn = F.row_number().over(Window.partitionBy("id", "_fits").orderBy("pos"))
    asked = asked.withColumn("_fits", F.col("rev").eqNullSafe(F.col("_have")))
    ok = F.col("_fits") & (turn == 1)
    new_rev = F.when(~F.col("deleted"), local_revision(stable_body("body")))
    judged = asked.withColumn("status", F.when(ok, "ok").otherwise("conflict")).withColumn("new_rev", F.when(F.col("status") == "ok", new_rev))
    taken = judged.where("status = 'ok'")
    after = store.join(taken.select("id"), "id", "left_anti").select("id", "rev", "body").unionByName(taken.where("not deleted").select("id", F.col("new_rev").alias("rev"), "body"))
    return after, judged.select("pos", "id", F.col("new_rev").alias("rev"), "status")
