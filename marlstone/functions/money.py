"""Settlement and conversion formulas on decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the share of a day's turnover that is kept as commission.
COMMISSION = "0.25"


def _commission(total: Column) -> Column:
    return total * F.lit(COMMISSION).cast("decimal(3,2)")


def processing_fee(total: Column, bonus: Column) -> Column:
    """The commission, or nothing where bonus payments leave no room for it."""
    fee = _commission(total)
    return F.when(total - fee - bonus > 0, fee).otherwise(F.lit(0)).cast("decimal(14,2)")


def reward(total: Column, bonus: Column) -> Column:
    """What is left for the restaurant: less commission and bonuses, or less bonuses where that is not positive."""
    rest = total - _commission(total) - bonus
    return F.when(rest > 0, rest).otherwise(total - bonus).cast("decimal(14,2)")


def converted(amount: Column, rate: Column) -> Column:
    return amount * rate


def share_per(count: Column, distinct: Column) -> Column:
    """count / distinct to three places; null when nothing is counted."""
    return F.round(F.try_divide(count.cast("double"), distinct.cast("double")), 3)
