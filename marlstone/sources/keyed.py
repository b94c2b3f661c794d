"""Keyed tables: Parquet in hash buckets of the key, changed only where a batch has keys.

A merge reads and writes the buckets that its batch touches. What it writes goes to a folder of its own; a small version
file then names the folders of every bucket, so a merge is seen as a whole or not at all, and readers of the version
before are not disturbed. The version also keeps the number of the last batch of each writer: a batch that comes again
after a stop changes nothing. One writer at a time changes a table; the store must rename files in one step.

Inserts only add rows: their buckets get a further folder instead of being rewritten, until there are ``FOLDERS``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators.upsert import latest

BUCKETS = 64
#: Parts into which a batch is staged, and the bytes from which they are worked off one after the other.
PARTS, LARGE = 4, 16 << 20
#: Folders of a bucket that inserts may leave; the next one makes them one again.
FOLDERS = 16
#: Versions whose folders stay for readers that have begun.
KEPT = 3
BUCKET = "_bucket"
PART = "_part"
#: Tells the batch's rows from the stored ones.
NEW = "_new"
#: Codec of all that is written here, and options for messages: text that is read once or twice, and is most of what lies there.
CODEC = "zstd"
TEXT = {"compression": CODEC, "parquet.compression.codec.zstd.level": "9"}


def _fs(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return made, made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    made, fs = _fs(spark, path)
    found = fs.globStatus(made(f"{path}/_versions/*.json"))
    return sorted(x.getPath().toString() for x in found or [])


def _load(spark: SparkSession, file: str) -> dict:
    made, fs = _fs(spark, file)
    stream = fs.open(made(file))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, version: dict) -> None:
    """Writes a version aside and renames it; then lets go of what no kept version names."""
    made, fs = _fs(spark, path)
    aside, file = made(f"{path}/_versions/{uuid.uuid4().hex}.tmp"), made(f"{path}/_versions/{number:012d}.json")
    stream = fs.create(aside)
    stream.write(bytearray(json.dumps(version).encode()))
    stream.close()
    if fs.exists(file) or not fs.rename(aside, file):
        fs.delete(aside, False)
        raise RuntimeError(f"another writer has changed {path}")
    files = _versions(spark, path)
    if len(files) > KEPT:
        gone = [_load(spark, x) for x in files[: len(files) - KEPT]]
        used = {p for x in files[-KEPT:] for p in _folders(_load(spark, x))}
        for p in {p for v in gone for p in _folders(v)} - used:
            fs.delete(made(f"{path}/data/{p}"), True)
        for x in files[: len(files) - KEPT]:
            fs.delete(made(x), False)


def _folders(version: dict, buckets: list[int] | None = None) -> list[str]:
    own = version["folders"]
    return [f"{x}/{BUCKET}={k}" for k in (own if buckets is None else map(str, buckets)) for x in own.get(k, [])]


def _rows(spark: SparkSession, path: str, version: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(version["schema"])
    folders = [f"{path}/data/{x}" for x in _folders(version, buckets)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as its last version has it."""
    files = _versions(spark, path)
    if not files:
        raise FileNotFoundError(f"no keyed table at {path}")
    return _rows(spark, path, _load(spark, files[-1]))


def last_batch(spark: SparkSession, path: str, writer: str = "") -> int:
    """The number of the writer's last batch in the table; -1 if there is none."""
    files = _versions(spark, path)
    return _load(spark, files[-1])["batches"].get(writer, -1) if files else -1


@contextmanager
def staged(dfs: Iterable[DataFrame], at: str, part: Column | None = None) -> Iterator[str]:
    """A folder below ``at`` with the rows of all ``dfs``, one after the other, that is let go in the end.

    Unlike a kept plan it fills neither memory nor the executors' disks; who reads few columns reads no others, and the
    shuffles that made the rows are not needed again. With ``part``, a small number, ``parts`` finds rows by it: a task
    writes a file for each, so nothing is shuffled.
    """
    aside = None
    try:
        for df in dfs:
            spark, aside = df.sparkSession, aside or f"{at}/_staged-{uuid.uuid4().hex}"
            w = (df if part is None else df.withColumn(PART, part)).write.mode("append").option("compression", CODEC)
            (w if part is None else w.partitionBy(PART)).parquet(aside)
        yield aside
    finally:
        if aside:
            made, fs = _fs(spark, aside)
            fs.delete(made(aside), True)


def _parts(spark: SparkSession, aside: str, schema: StructType, one: int | None = None) -> list[tuple[DataFrame, list]]:
    made, fs = _fs(spark, aside)
    found = {int(x.getPath().getName().split("=")[1]): x.getPath() for x in fs.globStatus(made(f"{aside}/{PART}=*")) or []}
    found = {k: p for k, p in sorted(found.items()) if (k == one if one is not None else k < PARTS)}
    few = sum(fs.getContentSummary(p).getLength() for p in found.values()) <= LARGE
    groups = [list(found.values())] if few else [[p] for p in found.values()]
    return [(spark.read.schema(schema).parquet(*(p.toString() for p in g)), g) for g in groups if g]


def parts(spark: SparkSession, aside: str, schema: StructType, one: int | None = None) -> list[DataFrame]:
    """The rows of a folder that ``staged`` has made by parts: as one frame if they are few, else as one for each part.

    Only parts below ``PARTS`` are among them; ``one`` names another part, which comes alone.
    """
    return [df for df, _ in _parts(spark, aside, schema, one)]


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Queries that start within let go of a write's shuffle files when it ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def part_of(spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> Column:
    """The part of a batch for the table: a bucket's rows are in one part."""
    files = _versions(spark, path)
    return _bucket(keys, _load(spark, files[-1])["buckets"] if files else buckets) % PARTS


def merge(
    batch: DataFrame,
    path: str,
    keys: list[str],
    how: Callable[[DataFrame, DataFrame], DataFrame],
    batch_id: int | None = None,
    writer: str = "",
    buckets: int = BUCKETS,
    adds: bool = False,
    stored: str | None = None,
    dealt: bool = False,
) -> list[int] | None:
    """Changes the table by ``how(stored, batch)`` and returns the touched buckets; None if the batch is in it already.

    ``how`` is given the touched buckets' rows. It gives their new rows, or with ``adds`` just the rows to add; with
    ``dealt`` it is given the rows' buckets too, and gives rows that are dealt by them already. The first merge makes the
    table, its schema and its number of buckets. The batch is read more than once, so it is staged first unless it comes
    from a folder (``stored``) by ``part_of``. A large one is merged part by part, each with buckets of its own, so the
    shuffles of one part at a time are on the disks; the version is written when all are done.
    """
    spark = batch.sparkSession
    files = _versions(spark, path)
    version = _load(spark, files[-1]) if files else {"buckets": buckets, "schema": batch.schema.jsonValue(), "batches": {}, "folders": {}}
    if batch_id is not None and version["batches"].get(writer, -1) >= batch_id:
        return None
    names, bucket = StructType.fromJson(version["schema"]).names, _bucket(keys, version["buckets"])
    folders, touched = dict(version["folders"]), []
    with nullcontext(stored) if stored else staged([batch], f"{path}/data", bucket % PARTS) as aside, shuffles_let_go(spark):
        for rows, paths in _parts(spark, aside, batch.schema):
            # at most one small row for each bucket
            own = sorted(r[0] for r in rows.select(bucket.alias(BUCKET)).distinct().collect())
            touched += own
            known = _rows(spark, path, version, own)
            new = how(known.withColumn(BUCKET, bucket), rows.withColumn(BUCKET, bucket)) if dealt else how(known, rows).select(*names).withColumn(BUCKET, bucket).repartition(BUCKET)
            full = [k for k in own if not adds or len(folders.get(str(k), [])) >= FOLDERS]
            if adds and full:
                new = new.unionByName(_rows(spark, path, version, full).withColumn(BUCKET, bucket)).repartition(BUCKET)
            at = uuid.uuid4().hex
            new.select(*names, BUCKET).write.option("compression", CODEC).partitionBy(BUCKET).parquet(f"{path}/data/{at}")
            made, fs = _fs(spark, path)
            written = {x.getPath().getName().split("=")[1] for x in fs.globStatus(made(f"{path}/data/{at}/{BUCKET}=*")) or []}
            for k in map(str, own):
                kept = [] if int(k) in full else folders.get(k, [])
                folders[k] = kept + ([at] if k in written else [])
            for p in [] if stored else paths:  # merged, and nobody else's
                fs.delete(p, True)
    marks = version["batches"] | ({} if batch_id is None else {writer: batch_id})
    number = int(files[-1].rsplit("/", 1)[1].split(".")[0]) + 1 if files else 0
    _commit(spark, path, number, version | {"folders": {k: x for k, x in folders.items() if x}, "batches": marks})
    return sorted(touched)


def _both(t: DataFrame, b: DataFrame) -> DataFrame:
    """Stored and new rows by bucket: the one shuffle of a merge, as keys and writers are content with it."""
    return t.withColumn(NEW, F.lit(False)).unionByName(b.select(*t.columns).withColumn(NEW, F.lit(True))).repartition(BUCKET)


def upsert_into(batch: DataFrame, path: str, keys: list[str], order_by: list[str], **options) -> list[int] | None:
    """The batch's latest row of each key replaces the stored one."""
    return merge(batch, path, keys, lambda t, b: latest(_both(t, b), [BUCKET, *keys], [NEW, *order_by]), dealt=True, **options)


def newest_into(batch: DataFrame, path: str, keys: list[str], order_by: list[str], **options) -> list[int] | None:
    """Of stored and new rows of a key the latest by ``order_by`` stays, so a late row never replaces a newer one."""
    return merge(batch, path, keys, lambda t, b: latest(_both(t, b).drop(NEW), [BUCKET, *keys], order_by), dealt=True, **options)


def insert_into(batch: DataFrame, path: str, keys: list[str], order_by: list[str] | None = None, **options) -> list[int] | None:
    """Rows of keys that the table lacks are added; what is written grows with them, not with the table."""

    def how(t: DataFrame, b: DataFrame) -> DataFrame:
        at = [BUCKET, *keys]
        rest = [NEW, *dict.fromkeys([*(order_by or []), *(c for c in t.columns if c not in at)])]
        # of stored rows the keys are enough: they come first, and where one does nothing is added
        known = t.select(*at, *(F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns if c not in at))
        one = _both(known, b).groupBy(*at).agg(F.min(F.struct(*rest)).alias("_b")).where(f"_b.{NEW}")
        return one.select(*(F.col(c) if c in at else F.col(f"_b.{c}").alias(c) for c in t.columns))

    return merge(batch, path, keys, how, adds=True, dealt=True, **options)


def add_into(batch: DataFrame, path: str, keys: list[str], column: str, **options) -> list[int] | None:
    """The batch's counts are added to the stored ones."""
    return merge(batch, path, keys, lambda t, b: _both(t, b).groupBy(BUCKET, *keys).agg(F.sum(column).alias(column)), dealt=True, **options)


def publish(dfs: DataFrame | list[DataFrame], at: str, batch_id: int) -> bool:
    """A batch's rows for the next stage, in a folder that appears as a whole, once, and is never changed.

    A batch that comes again finds its folder and leaves it as it is: a stream that reads ``at`` sees each row once.
    Several frames are written one after the other, so the shuffles of one at a time are on the disks.
    """
    dfs = dfs if isinstance(dfs, list) else [dfs]
    spark = dfs[0].sparkSession
    made, fs = _fs(spark, at)
    here = made(f"{at}/batch_id={batch_id}")
    if fs.exists(here):
        return False
    for x in fs.globStatus(made(f"{at}/_new-*")) or []:  # of a stop
        fs.delete(x.getPath(), True)
    aside = f"{at}/_new-{uuid.uuid4().hex}"
    with shuffles_let_go(spark):
        for df in dfs:
            df.write.mode("append").options(**TEXT).parquet(aside)
    if not fs.rename(made(aside), here):
        raise RuntimeError(f"another writer has published {here}")
    return True
