"""Scans over long histories in bounded tasks: within chunks of a key first, then over one row for each chunk.

A running value of a key (the last one known, a count) would bring the whole history of a key to one task. Here a key's
rows are cut into chunks along the order, so tasks hold chunks; each chunk tells its edge in one row, a window over these
small rows carries the value from chunk to chunk, and a join by chunk gives every row what came before its chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import shared_dir

#: The name of the column that names a row's key and chunk.
SEGMENT = "_segment"


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, for plans that read it on two ways."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def segmented(df: DataFrame, by: list[str], **chunk: Column) -> DataFrame:
    """``df`` with its segment: the key columns and the chunk's. A segment is never null, though its parts may be."""
    return df.withColumn(SEGMENT, F.struct(*by, *(c.alias(n) for n, c in chunk.items())))


def _edge(value: Column, order: list[str], last: bool) -> Column:
    """The last (or first) value of a group that is not null, by ``order``."""
    best = (F.max if last else F.min)(F.when(value.isNotNull(), F.struct(*order, value.alias("_v"))))
    return best["_v"]


def fill(df: DataFrame, by: list[str], order: list[str], value: Column, before: list[Column], after: list[Column] | None = None) -> tuple[DataFrame, str, str]:
    """``df`` with, for every row, the last value at or before it, and the first at or after it if ``after`` is given.

    ``df`` has segments; rows of a segment are ordered by ``order``. Segments of a key are walked by ``before`` on the
    way from the start and by ``after`` on the way from the end; both frames only grow, so the work is linear. Returns
    the rows and the names of the two columns.
    """
    upto, until = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    own = Window.partitionBy(SEGMENT)
    key = Window.partitionBy(*(F.col(f"{SEGMENT}.{b}") for b in by))
    edges = df.groupBy(SEGMENT).agg(_edge(value, order, True).alias("_last"), _edge(value, order, False).alias("_first"))
    local = {"_back": F.last(value, True).over(own.orderBy(*order).rowsBetween(*upto))}
    carried = [F.last("_last", True).over(key.orderBy(*before).rowsBetween(*until)).alias("_c_back")]
    if after is not None:
        local["_fore"] = F.last(value, True).over(own.orderBy(*(F.desc(c) for c in order)).rowsBetween(*upto))
        carried.append(F.last("_first", True).over(key.orderBy(*after).rowsBetween(*until)).alias("_c_fore"))
    edges = edges.select(F.col(SEGMENT).alias("_s"), *carried)
    j = df.withColumns(local).join(edges, F.col(SEGMENT) == F.col("_s"), "left")
    out = {n: F.coalesce(n, f"_c{n}") for n in local}
    return j.withColumns(out).drop("_s", "_c_back", "_c_fore", SEGMENT), "_back", "_fore"


def runs(df: DataFrame, by: list[str], order: list[str], value: str, chunk_order: list[Column], *aggregates: Column) -> DataFrame:
    """One row for each run of equal values (not null) of a key along ``order``: key, run_id from 1, value, aggregates.

    Aggregates must be such that they can be made in two steps by the same function (minima, maxima), with their own
    names. Runs are found within segments; a segment's first run goes on with the last one of the segment before.
    """
    df = once(df)
    w = Window.partitionBy(SEGMENT).orderBy(*order)
    before = F.lag(value).over(w)
    flagged = df.withColumn("_new", F.when(before.isNotNull() & (before != F.col(value)), 1).otherwise(0))
    numbered = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = numbered.groupBy(SEGMENT, "_run").agg(F.min(value).alias(value), *aggregates)
    edges = numbered.groupBy(SEGMENT).agg(F.max("_run").alias("_n"), F.min(F.struct("_run", value)).alias("_a"), F.max(F.struct("_run", value)).alias("_z"))
    key = Window.partitionBy(*(F.col(f"{SEGMENT}.{b}") for b in by)).orderBy(*chunk_order)
    goes_on = F.coalesce(F.lag(f"_z.{value}").over(key) == F.col(f"_a.{value}"), F.lit(False))
    edges = edges.withColumn("_starts", F.when(goes_on, 0).otherwise(1))
    # runs that begin in the segments before this one, and whether its own first run begins here
    through = F.sum(F.col("_n") + F.col("_starts")).over(key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    edges = edges.select(F.col(SEGMENT).alias("_s"), through.alias("_offset"))
    return local.join(edges, F.col(SEGMENT) == F.col("_s")).select(
        *(F.col(f"{SEGMENT}.{b}").alias(b) for b in by), (F.col("_offset") + F.col("_run")).alias("run_id"), *(c for c in local.columns if c not in (SEGMENT, "_run"))
    )
