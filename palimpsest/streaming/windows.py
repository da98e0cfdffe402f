"""Timers over events in batch form: quiet windows, fixed windows from a first event, and lockouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _time(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def debounce(events: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """(keys, started, fires, events): a run is armed again by each event and fires after a quiet time."""
    own = Window.partitionBy(*keys).orderBy(ts)
    t = _micros(ts)
    new = F.when(t - F.lag(t).over(own) < int(seconds * 1e6), 0).otherwise(1)
    runs = events.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(ts).alias("started"), _time(F.max(t) + int(seconds * 1e6)).alias("fires"), F.count(F.lit(1)).alias("events")).drop("_run")


def coalesce(events: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """(keys, started, events): a run begins with an event and takes in all of the time that follows; it is not extended.

    Where a run begins depends on where the last one did, so events of a key are folded in order."""
    span = int(seconds * 1e6)
    times = events.groupBy(*keys).agg(F.sort_array(F.collect_list(_micros(ts))).alias("_t"))
    # closed runs, then the start and the events of the open one
    folded = F.expr(
        f"""aggregate(_t, struct(cast(array() as array<struct<start:bigint,n:bigint>>) as done, cast(null as bigint) as start, 0L as n),
          (s, t) -> if(s.start is null or t >= s.start + {span},
            struct(if(s.start is null, s.done, array_append(s.done, struct(s.start as start, s.n as n))) as done, t as start, 1L as n),
            struct(s.done as done, s.start as start, s.n + 1L as n)),
          s -> array_append(s.done, struct(s.start as start, s.n as n)))"""
    )
    return times.select(*keys, F.explode(folded).alias("r")).select(*keys, _time(F.col("r.start")).alias("started"), F.col("r.n").alias("events"))


def lockout(attempts: DataFrame, keys: list[str], ts: str, failed: str, most: int = 10, window: float = 60, hold: float = 900) -> DataFrame:
    """``attempts`` with ``locked``: after more than ``most`` failures within ``window`` seconds a key is shut for ``hold``
    seconds, for good attempts too."""
    own = Window.partitionBy(*keys).orderBy(F.col("_us"))
    recent = own.rangeBetween(-int(window * 1e6), 0)
    rows = attempts.withColumn("_us", _micros(ts)).withColumn("_bad", F.sum(F.col(failed).cast("int")).over(recent))
    tripped = F.when(F.col(failed) & (F.col("_bad") > most), F.col("_us"))
    held = F.max(tripped).over(own.rangeBetween(-int(hold * 1e6), -1))
    return rows.withColumn("locked", held.isNotNull()).drop("_us", "_bad")
