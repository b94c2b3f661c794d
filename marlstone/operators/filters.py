"""Row filters: completeness, ranges, routing, changes and quarantine. All of them push down where the source allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all these columns have values."""
    return df.dropna(subset=list(columns))


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Both bounds included; an open side for None."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def on_day(df: DataFrame, column: str, day) -> DataFrame:
    """Rows of one date; written as a range, so that it reaches the scan."""
    start = F.to_timestamp(F.lit(str(day)))
    return df.where((F.col(column) >= start) & (F.col(column) < start + F.expr("INTERVAL 1 DAY")))


def active(df: DataFrame, start: str, end: str, now: Column) -> DataFrame:
    """Rows whose interval of epoch seconds holds ``now``, both bounds excluded."""
    return df.where((F.col(start) < now) & (F.col(end) > now))


def differs(columns: list[str], left: str, right: str) -> Column:
    """Some of the columns differ between two aliases; null equals null."""
    return reduce(
        lambda a, b: a | b,
        (~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns),
        F.lit(False),
    )


def changed(incoming: DataFrame, stored: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Incoming rows that are new or differ from the stored row of their key."""
    j = incoming.alias("i").join(stored.alias("s"), [F.col(f"i.{k}") == F.col(f"s.{k}") for k in keys], "left")
    is_new = reduce(lambda a, b: a & b, (F.col(f"s.{k}").isNull() for k in keys))
    return j.where(is_new | differs(compare, "i", "s")).select("i.*")


def routed(df: DataFrame, object_type: str) -> DataFrame:
    """Messages of one type that carry a payload."""
    return df.where((F.col("object_type") == object_type) & F.col("payload").isNotNull())


def sampled(df: DataFrame, fraction: float | None, seed: int = 42) -> DataFrame:
    """A row sample; everything for None."""
    return df if fraction is None else df.sample(fraction=fraction, seed=seed)


def sampled_keys(df: DataFrame, fraction: float, *keys: str, seed: int = 42) -> DataFrame:
    """All rows of a share of the keys: those whose hash lies below a threshold.

    A key is in or out whatever the partitions, the order or the other rows are, and tables that share keys are sampled
    alike. A null key counts as an empty one.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return df.where(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") < int(fraction * 2**32))
