"""Keyed tables: touched buckets only, versions, batches that come again."""

import time

import pytest
from pyspark.sql import functions as F

from marlstone.sources import keyed

SCHEMA = "k int, v string, ts int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def make(spark, *x):
    return spark.createDataFrame(list(x), SCHEMA)


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert_into(make(spark, *((i, "a", 1) for i in range(400)), (None, "n", 1)), path, ["k"], ["ts"], batch_id=0, buckets=20)
    before = keyed._load(spark, keyed._versions(spark, path)[-1])
    touched = keyed.upsert_into(make(spark, (5, "b", 2), (5, "c", 3), (1000, "d", 1), (None, "m", 2)), path, ["k"], ["ts"], batch_id=1)
    after = keyed._load(spark, keyed._versions(spark, path)[-1])
    assert 1 <= len(touched) <= 3 and {k for k, x in after["folders"].items() if x != before["folders"].get(k)} == {str(k) for k in touched}
    got = {r.k: r.v for r in keyed.read(spark, path).collect()}
    assert len(got) == 402 and (got[5], got[1000], got[None], got[6]) == ("c", "d", "m", "a")
    # the plan of a merge scans the touched buckets' folders and no others
    seen = []
    keyed.merge(make(spark, (5, "z", 9)), path, ["k"], lambda t, b: seen.append(t.inputFiles()) or t.unionByName(b))
    assert seen[0] and len({f.split("_bucket=")[1].split("/")[0] for f in seen[0]}) == 1


def test_a_batch_is_taken_once(spark, tmp_path):
    path, batch = str(tmp_path / "t"), make(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1))
    counts = lambda df: df.groupBy("k").count()
    assert keyed.add_into(counts(batch), path, ["k"], "count", batch_id=0, writer="a") is not None
    assert keyed.add_into(counts(batch), path, ["k"], "count", batch_id=0, writer="a") is None
    keyed.add_into(counts(batch), path, ["k"], "count", batch_id=0, writer="b")
    assert rows(keyed.read(spark, path)) == [(1, 4), (2, 2)] and keyed.last_batch(spark, path, "b") == 0 and keyed.last_batch(spark, path, "c") == -1
    assert keyed.add_into(counts(batch.limit(0)), path, ["k"], "count", batch_id=1, writer="a") == []
    assert rows(keyed.read(spark, path)) == [(1, 4), (2, 2)]


def test_inserts_add_files_and_never_change_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(20):  # beyond FOLDERS: buckets are made one again
        keyed.insert_into(make(spark, (-1, f"x{i}", i), (i, "first", i), (i, "later", i + 1)), path, ["k"], ["ts"], batch_id=i, buckets=2)
    got = rows(keyed.read(spark, path))
    assert got == sorted([(-1, "x0", 0), *((i, "first", i) for i in range(20))], key=repr)
    version = keyed._load(spark, keyed._versions(spark, path)[-1])
    assert all(len(x) <= keyed.FOLDERS for x in version["folders"].values())
    assert len(keyed._versions(spark, path)) == keyed.KEPT


def test_newest_stays(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in ([(1, "a", 5)], [(1, "late", 3), (2, "b", 1)], [(2, "c", 2)]):
        keyed.newest_into(make(spark, *batch), path, ["k"], ["ts"])
    assert rows(keyed.read(spark, path)) == [(1, "a", 5), (2, "c", 2)]


def test_a_stop_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.upsert_into(make(spark, (1, "a", 1), (2, "b", 1)), path, ["k"], ["ts"], batch_id=0)

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", stopped)  # after the data, before the version
        with pytest.raises(KeyboardInterrupt):
            keyed.upsert_into(make(spark, (1, "z", 2)), path, ["k"], ["ts"], batch_id=1)
    assert rows(keyed.read(spark, path)) == [(1, "a", 1), (2, "b", 1)]
    keyed.upsert_into(make(spark, (1, "z", 2)), path, ["k"], ["ts"], batch_id=1)
    assert rows(keyed.read(spark, path)) == [(1, "z", 2), (2, "b", 1)]
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, str(tmp_path / "none"))


def test_publish_once(spark, tmp_path):
    at = str(tmp_path / "p")
    (tmp_path / "p").mkdir()
    assert keyed.publish(make(spark, (1, "a", 1)), at, 0) and not keyed.publish(make(spark, (9, "z", 9)), at, 0)
    (tmp_path / "p" / "_new-left").mkdir()  # of a stop
    assert keyed.publish(make(spark, (2, "b", 1)), at, 1)
    assert rows(spark.read.parquet(at).drop("batch_id")) == [(1, "a", 1), (2, "b", 1)]
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["batch_id=0", "batch_id=1"]


def test_a_batch_is_neither_kept_nor_left(spark, tmp_path):
    """While a batch is merged it lies in files, not in the executors' memory; they are gone behind it."""
    path, seen = str(tmp_path / "t"), []

    def how(t, b):
        seen.append((b.storageLevel.useMemory, len(b.inputFiles())))
        return t.unionByName(b)

    keyed.merge(make(spark, (1, "a", 1), (2, "b", 1)), path, ["k"], how)
    assert seen[0][0] is False and seen[0][1] > 0
    assert not list((tmp_path / "t").rglob("_staged-*")) and rows(keyed.read(spark, path)) == [(1, "a", 1), (2, "b", 1)]


def test_shuffles_are_let_go(spark, tmp_path):
    """A write's shuffle files go with its end, within the setting's scope; the setting is as before behind it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, left = spark.conf.get(name), lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    with keyed.shuffles_let_go(spark):
        n = left()
        spark.range(10000).groupBy((F.col("id") % 1000).alias("k")).count().write.parquet(str(tmp_path / "x"))
        for _ in range(100):  # files go a little later
            if left() <= n:
                break
            time.sleep(0.1)
        assert left() <= n
    assert spark.conf.get(name) == before


def _shuffled(spark):
    """How many rows each stage so far has shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}


@pytest.mark.parametrize("into", [keyed.insert_into, keyed.upsert_into, keyed.newest_into])
def test_a_merge_shuffles_its_rows_once(spark, tmp_path, into):
    n, before = 4000, _shuffled(spark)
    into(make(spark, *((i, f"v{i}", 1) for i in range(n))), str(tmp_path / "t"), ["k"], ["ts"], buckets=8)
    assert keyed.read(spark, str(tmp_path / "t")).count() == n
    assert sum(x for k, x in _shuffled(spark).items() if k not in before) < 1.2 * n


@pytest.mark.parametrize("buckets", [3, 16])
def test_large_batches_are_merged_part_by_part(spark, tmp_path, monkeypatch, buckets):
    """No stage has a whole batch in its shuffle, the result is the same, and nothing is left of what was staged."""
    monkeypatch.setattr(keyed, "LARGE", 0)
    path, n = str(tmp_path / "t"), 4000
    before = _shuffled(spark)
    keyed.insert_into(make(spark, *((i, f"v{i}", 1) for i in range(n)), (None, "none", 1)), path, ["k"], ["ts"], batch_id=0, buckets=buckets)
    assert max(x for k, x in _shuffled(spark).items() if k not in before) < 0.6 * n
    keyed.upsert_into(make(spark, *((i, "new", 2) for i in range(0, n, 2))), path, ["k"], ["ts"], batch_id=1)
    keyed.newest_into(make(spark, *((i, "late", 0) for i in range(n)), (n, "more", 0)), path, ["k"], ["ts"], batch_id=2)
    want = [(i, "new" if i % 2 == 0 else f"v{i}", 2 if i % 2 == 0 else 1) for i in range(n)] + [(None, "none", 1), (n, "more", 0)]
    assert rows(keyed.read(spark, path)) == sorted(want, key=repr)
    assert not list((tmp_path / "t").rglob("_staged-*"))
