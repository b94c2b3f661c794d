"""Column helpers that the native corpus operators share: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and word characters of the contracts, as Java patterns.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column, separators: str = SPACE) -> Column:
    """The pieces of a text between runs of ``separators``, none of them empty."""
    return F.array_remove(F.split(whole(text), separators), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays, unlike with lower()."""
    return F.translate(text, UPPER, LOWER)


def cover(starts: Column, width: int) -> Column:
    """How many places the intervals [s, s + width) cover; ``starts`` is sorted, without repeats."""
    gaps = F.transform(
        starts,
        lambda x, k: F.when(k == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(starts, k - 1))),
    )
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def others(df: DataFrame, *own: str) -> list[str]:
    """The columns of ``df`` that are none of ``own``; as for Spark, case does not part names."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added to those that are columns of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for x in names:
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out
