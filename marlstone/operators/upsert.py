"""Keyed writes as pure functions of (target, batch): the result is the new target.

A path is never overwritten while it is read: ``sinks.swap`` writes aside and renames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all_null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def latest(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row for each key: the last by ``order_by``, ties broken by all other columns.

    The pick is an aggregate, so rows are combined before the shuffle and a hot key cannot fill a task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [*order_by, *(c for c in rest if c not in order_by)]
    if not rest:
        return df.distinct()
    best = F.max(F.struct(*first)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Last write wins: the batch's latest row of each key replaces the target's."""
    new = latest(batch, keys, order_by).select(*target.columns)
    return target.join(new, _all_null_safe(target, new, keys), "left_anti").unionByName(new)


def absent(target: DataFrame, batch: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """The batch's first row (by ``order_by``) of each key that the target lacks."""
    rest = [c for c in batch.columns if c not in keys]
    first = [*(order_by or []), *(c for c in rest if c not in (order_by or []))]
    one = batch.distinct() if not rest else batch.groupBy(*keys).agg(F.min(F.struct(*first)).alias("_b")).select(*(F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in batch.columns))
    one = one.select(*target.columns)
    return one.join(target, _all_null_safe(one, target, keys), "left_anti")


def insert_absent(target: DataFrame, batch: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Rows of keys that the target lacks are added (the first by ``order_by``); stored rows never change."""
    return target.unionByName(absent(target, batch, keys, order_by))


def add_counts(target: DataFrame, delta: DataFrame, keys: list[str], column: str, carry: list[str] | None = None) -> DataFrame:
    """Counters of both sides are added by key; ``carry`` columns take the delta's value if it has one."""
    both = target.select("*", F.lit(0).alias("_new")).unionByName(delta.select(*target.columns, F.lit(1).alias("_new")))
    held = [F.max(F.when(F.col(c).isNotNull(), F.struct("_new", c))).alias(f"_{c}") for c in carry or []]
    out = both.groupBy(*keys).agg(F.sum(column).alias(column), *held)
    return out.select(*(F.col(f"_{c}.{c}").alias(c) if c in (carry or []) else F.col(c) for c in target.columns))


def scd1(target: DataFrame, batch: DataFrame, keys: list[str], update: list[str], order_by: list[str]) -> DataFrame:
    """New keys are inserted; of stored ones only the ``update`` columns follow the batch, the rest stay."""
    new = latest(batch, keys, order_by)
    t, b = target.alias("t"), new.alias("b")
    j = t.join(b, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys], "full")
    stored = F.col(f"t.{keys[0]}").isNotNull()
    fresh = F.col(f"b.{keys[0]}").isNotNull()
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}")).alias(c))
        elif c in update:
            out.append(F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.when(stored, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return j.select(*out)


#: The open ends of validity intervals.
FIRST_FROM, OPEN_TO = "1999-01-01", "2099-12-31"


def scd2(current: DataFrame, snapshots: DataFrame, scope: str, key: list[str], compare: list[str], effective: str) -> DataFrame:
    """Versions with half-open intervals [active_from, active_to) from stored versions and whole snapshots.

    A snapshot holds all keys of its scope (a menu of its restaurant) at one effective time; a key it lacks ends there,
    and several snapshots of a scope may come at once. The first version of a key opens at a fixed early date. All
    versions of a scope and key are ordered in one window; rows that repeat the version before them vanish, so the
    intervals of a key never overlap, and applying a batch again changes nothing.
    """
    k = [scope, *key]
    open_end = F.lit(OPEN_TO).cast("timestamp")
    nothing = [F.lit(None).cast(current.schema[c].dataType).alias(c) for c in compare]
    on = lambda at: F.struct(at.cast("timestamp").alias("_at"), F.lit(True).alias("_on"), *compare)
    off = lambda at: F.struct(at.cast("timestamp").alias("_at"), F.lit(False).alias("_on"), *nothing)
    stored = current.select(*k, F.explode(F.array_compact(F.array(on(F.col("active_from")), F.when(F.col("active_to") < open_end, off(F.col("active_to")))))).alias("_e"))
    seen = latest(snapshots, [*k, effective], compare).select(*k, on(F.col(effective)).alias("_e"))
    events = stored.unionByName(seen).select(*k, "_e.*")
    # every time of a scope knows the next snapshot, so a row looks up one time, whatever the number of keys and snapshots
    snap = F.col(effective).cast("timestamp")
    marks = snapshots.select(scope, snap.alias("_at"), snap.alias("_snap")).unionByName(current.select(scope, F.col("active_from").cast("timestamp").alias("_at"), F.lit(None).cast("timestamp").alias("_snap")))
    later = Window.partitionBy(scope).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.groupBy(scope, "_at").agg(F.max("_snap").alias("_snap")).select(scope, "_at", F.last("_snap", True).over(later).alias("_then"))
    events = events.join(marks, [scope, "_at"], "left")
    w = Window.partitionBy(*k).orderBy("_at", "_on")
    # a key ends at the first snapshot of its scope after it was seen, if nothing is known of it until then
    ends = F.col("_on") & F.col("_then").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("_then")))
    both = F.array_compact(F.array(on(F.col("_at")), F.when(ends, off(F.col("_then")))))
    own = F.when(F.col("_on"), both).otherwise(F.array(off(F.col("_at"))))
    events = events.withColumn("_next", F.lead("_at").over(w)).select(*k, F.explode(own).alias("_e")).select(*k, "_e.*")
    # a stored change and a snapshot at one time: the snapshot is newer only if it says something else
    state = F.struct("_on", *compare)
    steps = events.withColumn("_state", F.when(F.col("_on"), state))
    steps = steps.withColumn("_was", F.lag("_state").over(w)).where(~F.col("_state").eqNullSafe(F.col("_was")) | (F.col("_was").isNull() & F.col("_on")))
    steps = steps.withColumn("_next", F.lead("_at").over(w)).withColumn("_n", F.row_number().over(w))
    out = steps.where("_on")
    first = F.when((F.col("_n") == 1), F.least("_at", F.lit(FIRST_FROM).cast("timestamp"))).otherwise(F.col("_at"))
    return out.select(*k, *compare, first.alias("active_from"), F.coalesce("_next", open_end).alias("active_to")).where("active_from < active_to")


def current_versions(dim: DataFrame, key: list[str], now: Column | None = None) -> DataFrame:
    """The newest version of each key, if it is still active: its end is open or after ``now``."""
    now = F.current_timestamp() if now is None else now
    return latest(dim, key, ["active_to", "active_from"]).where(F.col("active_to") > now)
