"""Joins by time: each row meets the version of its key that held when it happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.session import checkpoint_ready


def asof(rows: DataFrame, versions: DataFrame, key: str, time: str, since: str) -> DataFrame:
    """``rows`` with ``version``, a struct of the latest row of ``versions`` of the same key with ``since`` <= ``time``, or null.

    Of versions of one moment the greatest, in order of their columns, holds. A
    null key or time meets none. Both sides are dealt together into ranges of
    (key, time), so that the rows of one key may lie on many tasks; what holds at
    the beginning of a range comes from a row for each key and range.
    """
    checkpoint_ready(rows.sparkSession)
    whole = F.struct(*[F.col(c) for c in versions.columns])
    own = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    both = own.select(F.col(key).alias("k"), F.col(since).alias("t"), F.lit(0).alias("kind"), whole.alias("v"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("r"))
    both = both.unionByName(rows.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(both.schema["v"].dataType).alias("v"), F.struct(*rows.columns).alias("r")))
    dealt = both.repartitionByRange("k", "t", "kind").withColumn("part", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy("k", "part").orderBy("t", "kind", "v").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("k", "part").agg(F.max(F.when(F.col("kind") == 0, F.struct("t", "v"))).alias("e"))
    carried = ends.select("k", "part", F.last("e", ignorenulls=True).over(earlier).alias("e")).where(F.col("e").isNotNull()).select("k", "part", F.col("e.v").alias("before"))
    found = dealt.select("*", F.last("v", ignorenulls=True).over(here).alias("held")).where("kind = 1").join(carried, ["k", "part"], "left")
    known = F.col("k").isNotNull() & F.col("t").isNotNull()
    return found.select("r.*", F.when(known, F.coalesce("held", "before")).alias("version"))


#: Refusals of a call, in the order in which they are looked for.
REFUSALS = (
    "unknown track", "the level doesn't allow this action", "L3 never acts on research", "unknown key", "the key is revoked or expired",
    "the key doesn't allow this", "the key isn't for this project")


def access_decisions(calls: DataFrame, keys: DataFrame, level_actions: dict[str, set[str]], tracks: tuple[str, ...]) -> DataFrame:
    """``calls`` (at, key, level, action, track, project, and others) with allowed and note, as of each call's time.

    ``keys`` (key, since, actions, tracks, projects, level, expires_at, revoked)
    are versions: a key is granted, changed or revoked by a new one. Null
    ``projects`` are all, a null ``level`` is any, a null ``expires_at`` is never.
    """
    d = asof(calls, keys, "key", "at", "since")
    v = lambda name: F.col(f"version.{name}")
    may: Column = F.lit(False)
    for level, actions in level_actions.items():
        may = may | ((F.col("level") == level) & F.col("action").isin(*actions))
    tests = (
        ~F.coalesce(F.col("track").isin(*tracks), F.lit(False)), ~F.coalesce(may, F.lit(False)), (F.col("level") == "L3") & (F.col("track") == "research"),
        F.col("version").isNull(), F.coalesce(v("revoked"), F.lit(False)) | F.coalesce(v("expires_at") <= F.col("at"), F.lit(False)),
        ~F.array_contains(v("actions"), F.col("action")) | ~F.array_contains(v("tracks"), F.col("track")) | F.coalesce(v("level") != F.col("level"), F.lit(False)),
        v("projects").isNotNull() & ~F.coalesce(F.array_contains(v("projects"), F.col("project")), F.lit(False)))
    note: Column = F.lit("")
    for test, reason in reversed(list(zip(tests, REFUSALS, strict=True))):
        note = F.when(F.coalesce(test, F.lit(False)), reason).otherwise(note)
    return d.withColumn("note", note).withColumn("allowed", F.col("note") == "").drop("version")
