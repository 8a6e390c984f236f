"""Accounts: lockout, sessions, availability of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCK_AFTER = 5


def lockouts(events: DataFrame, *, key: str, ts: str, tie: str, failed: Column, succeeded: Column, limit: int = LOCK_AFTER) -> DataFrame:
    """(key, locked_at): when a key's ``limit``-th failure since its last success came. The lock is for good.

    Runs are counted by a window that sorts and spills; a hot key's rows are two booleans and a time each.
    """
    rows = events.filter(failed | succeeded).select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(tie).alias("i"), failed.cast("int").alias("f"), succeeded.cast("int").alias("s"))
    w = Window.partitionBy("k").orderBy("t", "i")
    run = rows.withColumn("g", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = run.filter("f = 1").withColumn("n", F.row_number().over(Window.partitionBy("k", "g").orderBy("t", "i"))).filter(F.col("n") == limit)
    return nth.groupBy("k").agg(F.min("t").alias("locked_at")).withColumnRenamed("k", key)


def sessions_valid(starts: DataFrame, *, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Adds expires_at and valid; a session is still valid at the very moment it expires. A null time is never valid."""
    return starts.withColumn("expires_at", F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")).withColumn("valid", F.coalesce(F.col("expires_at") >= as_of, F.lit(False)))


def sessions(starts: DataFrame, ends: DataFrame, *, key: str, owner: str, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """(key, owner, expires_at, is_active, swept) of every session.

    A session is invalid from its owner's first row of ``ends`` after its start; expired ones are swept, active or not. Lookups
    take rows that are active and not swept.
    """
    s = starts.select(F.col(key), F.col(owner), F.col(ts).alias("_s"), F.lit(0).alias("_e")).unionByName(ends.select(F.lit(None).cast(starts.schema[key].dataType).alias(key), F.col(owner), F.col(ts).alias("_s"), F.lit(1).alias("_e")))
    after = Window.partitionBy(owner).orderBy(F.col("_s").desc(), F.col("_e")).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.last(F.when(F.col("_e") == 1, F.col("_s")), ignorenulls=True).over(after)
    rows = s.withColumn("_end", ended).filter("_e = 0")
    expires = F.col("_s") + F.expr(f"INTERVAL {hours} HOURS")
    return rows.select(key, owner, expires.alias("expires_at"), (F.col("_end").isNull() | (F.col("_end") > as_of)).alias("is_active"), F.coalesce(as_of > expires, F.lit(True)).alias("swept"))


def token_valid(issued: Column, kind: Column, as_of: Column, minutes: int = 30, wanted: str = "password_reset") -> Column:
    """Whether a token of the wanted type is within its minutes; null times and types are not."""
    return F.coalesce((kind == wanted) & (issued <= as_of) & (as_of <= issued + F.expr(f"INTERVAL {minutes} MINUTES")), F.lit(False))


def free_names(wanted: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """The wanted names that nobody holds in any case."""
    own = held.select(F.lower(name).alias("_n")).filter("_n IS NOT NULL")
    return wanted.join(own, F.lower(wanted[name]) == own["_n"], "left_anti")


def first_source(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, source): each key's row from the first source that has it."""
    parts = None
    for n, s in enumerate(sources):
        p = s.select(F.col(key).alias("key"), F.col(value).alias("value"), F.lit(n).cast("bigint").alias("source"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("key").agg(F.min(F.struct("source", "value")).alias("r")).select("key", "r.value", "r.source")
