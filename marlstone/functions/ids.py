"""Deterministic keys from business ids, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the X.500 namespace of RFC 4122.
X500 = "6ba7b8149dad11d180b400c04fd430c8"


def uuid3(name: Column, namespace: str = X500) -> Column:
    """The version-3 UUID of a name, in its canonical 36 characters; null stays null."""
    h = F.md5(F.concat(F.unhex(F.lit(namespace)), F.encode(name.cast("string"), "UTF-8")))
    # the version is 3; the variant's top bits are 10
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("3"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def hub_key(business_id: Column) -> Column:
    """The key of a hub row; null for a null id."""
    return F.when(business_id.isNotNull(), uuid3(business_id))


def link_key(left: Column, right: Column) -> Column:
    """The key of a link between two hub keys."""
    return F.when(left.isNotNull() & right.isNotNull(), uuid3(F.concat_ws("_", left, right)))


def row_id(*columns: Column) -> Column:
    """An id for events that have none: equal on every retry, as it is a hash of the row."""
    return F.xxhash64(*columns)
