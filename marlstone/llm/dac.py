"""Directly addressable codes: token ids in chunk levels with continuation bitmaps and rank directories.

An id is split into chunks of ``bits`` bits, lowest first. Level 0 holds the first chunk of every id; a bitmap says
which ids go on, and their next chunks lie in level 1 in the same order, and so on. The number of ones before a place
(from a directory entry for each 512 bits, and the bits between) is the id's place in the next level, so any token
can be read alone. A corpus is written as Parquet rows of segments, in ascending order of doc_id: each row holds the
codes of some hundred thousand ids with the ids and ends of its documents.

Defined results: null and empty texts hold just the end id; rows that share a doc_id follow each other (by the hash of
their texts), each with its own range; null ids come first; an empty table gives an empty result; other columns are
not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import textkit
from marlstone.llm.bytebpe import Encoder
from marlstone.llm.store import written
from marlstone.session import ship

MAGIC = b"DAC1"
BITS = 8
BLOCK = 512
SEGMENT_IDS = 500_000
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"


def encode(ids: np.ndarray, bits: int = BITS) -> bytes:
    """The codes of an array of non-negative ids below 2**32."""
    rest = np.asarray(ids, dtype=np.uint32)
    head, parts = [], []
    while True:
        low = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else np.uint16)
        high = rest >> np.uint32(bits)
        more = high > 0
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        head.append(struct.pack("<QQQQ", len(low), low.nbytes, bitmap.nbytes, ranks.nbytes))
        parts += [low.astype(low.dtype.newbyteorder("<")).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest = high[more]
        if not len(rest):
            break
    return MAGIC + struct.pack("<BB", bits, len(head)) + b"".join(head) + b"".join(parts)


class Codes:
    """Reads the codes that ``encode`` has made: one id, a range, or all."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.bits, n = struct.unpack_from("<BB", data, 4)
        at = 6 + 32 * n
        self.levels = []
        for i in range(n):
            size, low, bitmap, ranks = struct.unpack_from("<QQQQ", data, 6 + 32 * i)
            chunk = np.frombuffer(data, np.uint8 if self.bits <= 8 else np.dtype("<u2"), size, at)
            bits = np.frombuffer(data, np.uint8, bitmap, at + low)
            directory = np.frombuffer(data, "<u4", ranks // 4, at + low + bitmap)
            self.levels.append((chunk, bits, directory))
            at += low + bitmap + ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, i: int) -> int:
        """One id, from as many bytes as it has chunks and at most a block of bits for each."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunk, bits, directory in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            between = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(directory[block]) + int(between.sum()), shift + self.bits
        return value

    def range(self, start: int, end: int) -> np.ndarray:
        """ids[start:end]; only those places of each level are read."""
        out = np.zeros(max(0, end - start), np.uint32)
        where, shift = np.arange(len(out)), 0
        for chunk, bits, directory in self.levels:
            if start >= end:
                break
            out[where] |= chunk[start:end].astype(np.uint32) << np.uint32(shift)
            base = start // BLOCK * BLOCK
            flags = np.unpackbits(bits[base // 8 : (end + 7) // 8], bitorder="little")[: end - base].astype(bool)
            before = int(directory[base // BLOCK]) + int(flags[: start - base].sum())
            more = flags[start - base :]
            where, shift = where[more], shift + self.bits
            start, end = before, before + int(more.sum())
        return out

    def all(self) -> np.ndarray:
        return self.range(0, len(self))


_loaded: dict = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process; the tokenizer's file lies on every machine."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _resolve(path: str) -> str:
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


SEGMENT = "part int, seq int, first bigint, n_ids bigint, doc_ids array<bigint>, ends array<bigint>, codes binary"


def write(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, bits: int = BITS, partitions: int | None = None) -> DataFrame:
    """Tokenise and write the segments; returns them as they are read back, one row each.

    ``first`` is the number of ids before the segment within its part; parts are ranges of doc_id in order.
    """
    spark = ship(docs.sparkSession)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    th = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", th.alias("th")).repartitionByRange(n, "doc_id", "th")
    ordered = ordered.sortWithinPartitions("doc_id", "th").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _encoder(_resolve(tokenizer))
        part, seq, first, held = TaskContext.get().partitionId(), 0, 0, 0
        names, pieces, ends = [], [], []

        def flush() -> pa.RecordBatch:
            row = [[part], [seq], [first], [held], [names], [np.asarray(ends)], [encode(np.concatenate(pieces), bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in SEGMENT.split(", ")])

        for b in batches:
            for i, j in textkit.slices(b):
                texts = [x or "" for x in b.column("text").slice(i, j - i).to_pylist()]
                for name, e in zip(b.column("doc_id").slice(i, j - i).to_pylist(), t.encode(texts), strict=True):
                    pieces.append(np.append(e, np.uint32(end_id)))
                    held += len(pieces[-1])
                    names.append(name)
                    ends.append(held)
                    if held >= SEGMENT_IDS:
                        yield flush()
                        seq, first, held = seq + 1, first + held, 0
                        names, pieces, ends = [], [], []
        if names:
            yield flush()

    return written(ordered.mapInArrow(run, SEGMENT), "dac")


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, from the segments; start counts the ids of all documents before it."""
    return _each(segments, "ids array<bigint>", pa.list_(pa.int64()), lambda ids: ids.astype(np.int64))


def _each(segments: DataFrame, column: str, kind: pa.DataType, of) -> DataFrame:
    from pyspark.sql import Window

    # one row for each part: as many as the writing job had tasks
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    rows = segments.join(F.broadcast(parts), F.col("part") == F.col("_p"))
    rows = rows.select((F.col("_before") + F.col("first")).alias("at"), "doc_ids", "ends", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, names, ends, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes, start = Codes(data), 0
                out: list[list] = [[], [], [], []]
                for name, end in zip(names, ends, strict=True):
                    for k, v in enumerate((name, at + start, end - start, of(codes.range(start, end)))):
                        out[k].append(v)
                    start = end
                kinds = (pa.int64(), pa.int64(), pa.int64(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    return rows.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {column}")


def tokens_at(segments: DataFrame, places: DataFrame) -> DataFrame:
    """(place, id) for each global token place in ``places``: only the segments that hold one are opened, and in them
    only the asked ids are decoded."""
    from pyspark.sql import Window

    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    s = segments.join(F.broadcast(parts), "part").select((F.col("before") + F.col("first")).alias("at"), "n_ids", "codes")
    # places meet segments by runs of SEGMENT_IDS ids: a segment reaches into two or three of them
    s = s.withColumn("run", F.explode(F.sequence(F.floor(F.col("at") / SEGMENT_IDS), F.floor((F.col("at") + F.col("n_ids") - 1) / SEGMENT_IDS))))
    asked = places.select("place").distinct().withColumn("run", F.floor(F.col("place") / SEGMENT_IDS))
    held = s.select("run", "at", "n_ids").join(asked, "run").where("place >= at AND place < at + n_ids")
    held = held.groupBy("at").agg(F.collect_list("place").alias("places"))
    pairs = s.dropDuplicates(["at"]).join(held, "at").select("at", "codes", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, asked_here in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes = Codes(data)
                ids = [codes.get(p - at) for p in asked_here]
                yield pa.RecordBatch.from_arrays([pa.array(asked_here, pa.int64()), pa.array(ids, pa.int64())], names=["place", "id"])

    return pairs.mapInArrow(run, "place bigint, id bigint")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, read from the written segments."""
    return _each(write(docs), "ids_crc32 bigint", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments that an earlier run has written."""
    return spark.read.schema(SEGMENT).parquet(path)
