"""Line dedup: lines that many documents share stay in one document only.

A line's key (stripped, A-Z in lower case) is named by a 128-bit digest. Digests are counted within tasks first, then by
one shuffle. Those that enough documents have are dealt to shards, and each shard becomes a minimal perfect hash: levels
of bitmaps, in each of which the digests that fall alone get their bit; a digest's slot is the rank of its bit. The slots
lead to three plain arrays: 64-bit fingerprints, counts, and the last document that holds the line. Documents probe
these arrays while they are read; their lines are neither joined nor shuffled.

The shards go to the executors only as long as their bytes are within ``broadcast_bytes``. Beyond that, the most frequent
digests do, up to the same bound. Lines that are not among them are dealt to the shards of the rest and probe the arrays
there: no digest of the rest is frequent, so no shard is hot, and only the places of lines to drop come back.

Defined results: null texts have one empty line and stay null; every row is a document, so repeated rows count as often as
they come, and rows of the largest id keep their lines alike. A row without an id counts, but holds no line if another
row has an id; lines that only rows without ids hold stay everywhere. Empty tables give empty results. Extra columns
are kept; if one is named like a column of the result (in any case), the result's gets an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marlstone.llm import textkit
from marlstone.llm.columns import unused, whole
from marlstone.llm.store import cut
from marlstone.session import ship

MIN_CHARS, MIN_DOCS = 40, 5
#: Digests of a shard, at most about.
SHARD = 1 << 18
#: Bytes of the arrays that go to every executor, and the bytes of a digest there (fingerprint, count, document, bits).
BROADCAST_BYTES, DIGEST_BYTES = 64 << 20, 21
#: Lines that meet in one task where lines are dealt to shards, about.
DEALT = 1 << 18
#: Counters of a task are emitted at so many digests.
HELD = 300_000
#: Fixed value: the white space of the contract.
SPACE = " \t\n\v\f\r"
_U = np.uint64
_LEVELS = 64


def digests(lines: list[str], min_chars: int) -> tuple[list[int], list[bytes]]:
    """Places and 128-bit digests of the lines whose keys are long enough."""
    at, out = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACE)
            if len(key) >= min_chars:
                at.append(i)
                out.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest())
    return at, out


def _halves(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, str]]:
    """Row numbers and texts, null as empty; only some of a batch are Python strings at a time."""
    column = batch.column(text)
    for start, end in textkit.slices(batch, text):
        for i, t in enumerate(column.slice(start, end - start).to_pylist(), start):
            yield i, t or ""


def counted(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """(hi, lo, n, last): digests that at least ``min_docs`` rows hold, and the largest id among these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            hi, lo = _halves(list(held))
            n, last = zip(*held.values(), strict=True) if held else ((), ())
            columns = [pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(n, pa.int64()), pa.array(last, pa.int64())]
            held.clear()
            return pa.record_batch(columns, names=["hi", "lo", "n", "last"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, t in _texts(batch, "t"):
                for x in set(digests(t.split("\n"), min_chars)[1]):
                    h = held.get(x)
                    if h is None:
                        held[x] = [1, ids[i]]
                    else:
                        h[0] += 1
                        if h[1] is None or ids[i] is not None and ids[i] > h[1]:
                            h[1] = ids[i]
                if len(held) >= HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t")).mapInArrow(count, "hi bigint, lo bigint, n bigint, last bigint")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where((F.col("n") >= min_docs) & F.col("last").isNotNull())


class Shard:
    """A minimal perfect hash over distinct digests, and the arrays that its slots lead to."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, last: np.ndarray):
        self.sizes, bits, left = [], [], np.arange(len(hi))
        while len(left):
            if len(self.sizes) == _LEVELS:
                raise ValueError("digests are not distinct")
            size = 64 * (2 * len(left) // 64 + 1)
            at = self._at(hi[left], lo[left], len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.bits = np.packbits(flat, bitorder="little")
        self._rank()
        slots = self.slots(hi, lo)
        self.prints, self.counts, self.last = np.empty(len(hi), _U), np.empty(len(hi), np.int64), np.empty(len(hi), np.int64)
        self.prints[slots], self.counts[slots], self.last[slots] = lo, n, last

    @staticmethod
    def _at(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (textkit.mix(hi ^ (lo * _U(2 * level + 1))) % _U(size)).astype(np.int64)

    def _rank(self) -> None:
        """The rank directory: how many bits stand before each byte."""
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.starts = np.cumsum([0, *self.sizes])

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest; a stranger gets any slot, or -1."""
        out, left = np.full(len(hi), -1), np.arange(len(hi))
        for level, size in enumerate(self.sizes):
            at = self._at(hi[left], lo[left], level, size) + self.starts[level]
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            held = self.bits[byte] >> bit
            on = (held & 1).astype(bool)
            below = self.bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8)
            out[left[on]] = (self.before[byte] + np.bitwise_count(below))[on]
            left = left[~on]
            if not len(left):
                break
        return out

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each digest is held here, in how many documents it is, and the last of them."""
        if not len(self.prints):
            return np.zeros(len(hi), bool), np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        s = self.slots(hi, lo)
        found = (s >= 0) & (self.prints[s] == lo)
        return found, np.where(found, self.counts[s], 0), np.where(found, self.last[s], 0)

    def row(self) -> dict:
        return {"sizes": self.sizes, "bits": self.bits.tobytes(), "prints": self.prints.tobytes(), "counts": self.counts.tobytes(), "last": self.last.tobytes()}

    @classmethod
    def of(cls, row) -> Shard:
        self = cls.__new__(cls)
        self.sizes = [int(x) for x in row["sizes"]]
        self.bits = np.frombuffer(row["bits"], np.uint8)
        self.prints, self.counts, self.last = np.frombuffer(row["prints"], _U), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["last"], np.int64)
        self._rank()
        return self


class Index:
    """Shards by the remainder of the digest's first half."""

    def __init__(self, shards: dict[int, Shard], n: int):
        self.shards, self.n = shards, n

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, last = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        of = (hi % _U(self.n)).astype(np.int64)
        for k in np.unique(of):
            if k in self.shards:
                at = np.flatnonzero(of == k)
                found[at], _, last[at] = self.shards[k].probe(hi[at], lo[at])
        return found, last


_ROW = "shard int, sizes array<int>, bits binary, prints binary, counts binary, last binary"


def _shard_of(n: int):
    """The unsigned remainder of hi, as numpy has it."""
    return F.expr(f"cast(pmod((cast(hi as decimal(20, 0)) + if(hi < 0, 18446744073709551616BD, 0BD)), {n}BD) as int)")


def shards(hot: DataFrame, n: int) -> DataFrame:
    """One row of arrays for each of ``n`` shards that has digests."""

    def build(t: pa.Table) -> pa.Table:
        whole_column = lambda c: t.column(c).to_numpy()
        s = Shard(whole_column("hi").view(_U), whole_column("lo").view(_U), whole_column("n"), whole_column("last"))
        return pa.Table.from_pylist([{"shard": t.column("shard")[0].as_py(), **s.row()}], pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("bits", "prints", "counts", "last"))]))

    return hot.withColumn("shard", _shard_of(n)).groupBy("shard").applyInArrow(build, _ROW)


def _cutoff(hot: DataFrame, most: int) -> tuple[int, int, int]:
    """(the least count that goes to all executors, digests from there on, digests in all)."""
    sizes = {r["k"]: r["n"] for r in hot.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    total, k, taken = sum(sizes.values()), max(sizes, default=0) + 1, 0
    while k > 0 and taken + sizes.get(k - 1, 0) <= most:
        k -= 1
        taken += sizes.get(k, 0)
    return 1 << k, taken, total


def dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES,
    shard: int = SHARD,
) -> DataFrame:
    """``docs`` without the lines that another document holds; n_lines and n_dropped besides.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents have lose all their lines but those
    of the document with the largest id.
    """
    spark = ship(docs.sparkSession)
    hot = cut(counted(docs, doc_id, text, min_chars, min_docs))
    least, taken, total = _cutoff(hot, broadcast_bytes // DIGEST_BYTES)
    n = -(-taken // shard) or 1
    # bounded: ``taken`` digests of DIGEST_BYTES each are within broadcast_bytes
    near = Index({r["shard"]: Shard.of(r) for r in shards(hot.where(F.col("n") >= least), n).collect()}, n)
    sent = spark.sparkContext.broadcast(near)
    lines_name, dropped_name = unused(docs, "n_lines", "n_dropped")
    known = docs
    places = None
    if taken < total:
        hi_name, lo_name, places = unused(docs, "digest_hi", "digest_lo", "places")
        far = _far(docs, hot.where(F.col("n") < least), sent, doc_id, text, min_chars, shard)
        keyed = docs.select("*", *(F.expr(x).alias(name) for x, name in zip(_text_key(text), (hi_name, lo_name), strict=True)))
        far = far.select(F.col("i").alias("_i"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("places").alias(places))
        on = F.col(doc_id).cast("bigint").eqNullSafe(F.col("_i")) & (F.col(hi_name) == F.col("_a")) & (F.col(lo_name) == F.col("_b"))
        known = keyed.join(far, on, "left").select(*docs.columns, places)
    names = list(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            ids = batch.column(doc_id).to_pylist()
            for start, end in textkit.slices(batch, text):
                part = batch.slice(start, end - start)
                split = [(t or "").split("\n") for t in part.column(text).to_pylist()]
                nulls = part.column(text).is_null().to_pylist()
                drop = [set(x or ()) for x in part.column(places).to_pylist()] if places else [set() for _ in split]
                rows, at, found = [], [], []
                for r, lines in enumerate(split):
                    p, d = digests(lines, min_chars)
                    rows += [r] * len(d)
                    at += p
                    found += d
                if found:
                    shared, last = index.probe(*_halves(found))
                    for k in np.flatnonzero(shared):
                        if ids[start + rows[k]] != last[k]:
                            drop[rows[k]].add(at[k])
                kept = [None if null else "\n".join(x for i, x in enumerate(lines) if i not in d) if d else "\n".join(lines) for lines, d, null in zip(split, drop, nulls, strict=True)]
                columns = [pa.array(kept, part.column(c).type) if c == text else part.column(c) for c in names]
                counts = [pa.array([len(x) for x in split], pa.int64()), pa.array([len(x) for x in drop], pa.int64())]
                yield pa.record_batch(columns + counts, names=[*names, lines_name, dropped_name])

    schema = StructType([*docs.schema.fields, StructField(lines_name, LongType()), StructField(dropped_name, LongType())])
    return known.mapInArrow(clean, schema)


def _text_key(text: str) -> tuple[str, str]:
    """Two 64-bit halves that name a text; equal rows get equal answers, so they may share one."""
    whole_text = f"coalesce(`{text}`, '')"
    return f"xxhash64({whole_text})", f"xxhash64({whole_text}, 7)"


def _far(docs: DataFrame, rest: DataFrame, sent, doc_id: str, text: str, min_chars: int, shard: int) -> DataFrame:
    """(i, a, b, places): the lines to drop among those that the sent shards do not know."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for start, end in textkit.slices(batch, "t"):
                part = batch.slice(start, end - start)
                rows, at, found = [], [], []
                for r, t in enumerate(part.column("t").to_pylist()):
                    p, d = digests((t or "").split("\n"), min_chars)
                    rows += [r] * len(d)
                    at += p
                    found += d
                if found:
                    hi, lo = _halves(found)
                    new = np.flatnonzero(~index.probe(hi, lo)[0])
                    who = part.select(["i", "a", "b"]).take(pa.array(np.array(rows)[new]))
                    columns = [*who.columns, pa.array(np.array(at, np.int32)[new]), pa.array(hi[new].view(np.int64)), pa.array(lo[new].view(np.int64))]
                    yield pa.record_batch(columns, names=["i", "a", "b", "place", "hi", "lo"])

    a, b = _text_key(text)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.expr(a).alias("a"), F.expr(b).alias("b"), F.col(text).alias("t"))
    dealt = cut(rows.mapInArrow(lines, "i bigint, a bigint, b bigint, place int, hi bigint, lo bigint"))
    size = rest.agg(F.count("*").alias("n")).first()["n"]
    n = max(-(-size // shard), -(-dealt.count() // DEALT), 1)

    def dropped(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["i", "a", "b", "place"]).slice(0, 0)
        whole_column = lambda c: left.column(c).to_numpy().view(_U)
        found, _, last = Shard.of(right.to_pylist()[0]).probe(whole_column("hi"), whole_column("lo"))
        ids = left.column("i").combine_chunks()
        own = np.asarray(ids.fill_null(0)) == last
        own &= ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
        return left.select(["i", "a", "b", "place"]).take(pa.array(np.flatnonzero(found & ~own)))

    out = dealt.withColumn("shard", _shard_of(n)).groupBy("shard").cogroup(shards(rest, n).groupBy("shard")).applyInArrow(dropped, "i bigint, a bigint, b bigint, place int")
    return out.groupBy("i", "a", "b").agg(F.collect_set("place").alias("places"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(whole(F.col("text")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id <> last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id
"""
