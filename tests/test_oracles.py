"""Every registered query with oracle SQL, run beside DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from marlstone.plans import registry

SF = os.environ.get("MARLSTONE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ").removesuffix(" 00:00:00").split("+")[0]
    return int(v) if isinstance(v, int) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns, found = rows_of(got.columns, got.collect())
    assert found
    if name in registry.ORACLES:
        r = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in r.description]
        want_columns, want = rows_of(names, r.fetchall())
        assert columns == want_columns
        assert found == want
