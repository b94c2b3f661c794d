"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct shingles. Equal sets become one class first. Each class is indexed under the
rarest part of its shingles (prefix filter, by a global order of frequency), so that any two linked sets meet in some
index list. Two relations between sets are used to skip work there:

* within the index: each list is sorted by size and place; the sizes that can still reach the threshold with a given
  set form a block, and of each size only the places that leave room for a link are looked at: both are found by
  search, the rest of the list is skipped;
* between answers: in a long list the sets are held against one set of like size first. Those that are highly similar
  share its component, and in the second round only pairs whose components still differ are looked at. There a set
  takes its answers over from those computed for a highly similar one, and only what their difference leaves open is
  computed (``Answers``).

A parity bitmap of each set bounds the overlap of a pair from above; pairs that pass are verified on their exact sets.

Shingle counts cover all documents; they order shingles, and never leave any out: the list of frequent shingles that
is sent to the executors holds the ``hot_keys`` most frequent at most, further ones only sort as if they were rare.

Defined results: texts that are null, empty or without words have no set and are linked with nothing; a text of fewer
words than the width is one shingle; rows that repeat an id each get its component; a row without an id takes part
and gets the smallest id of its component, if any; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit
from marlstone.llm.columns import unused
from marlstone.llm.store import cut
from marlstone.session import ship

WIDTH = 5
PERCENT = 75
#: Most shingles that are sent to the executors as frequent: 4 MB of keys.
HOT_KEYS = 1 << 19
HOT_FROM = 4
#: Lists up to this length give all their pairs in the first round.
SHORT = 12
CHUNK = 1_000_000
#: No task holds more than about twice so many entries of one list: longer lists are worked on in blocks of this size.
BLOCK = 4096
#: Shingles that a bucket of the index is meant for.
BUCKET = 1 << 21
#: Answers of a block that are kept, of each width of bitmaps, for sets that are like theirs.
KEPT = 16
#: Tasks that the rows of one list are dealt over where they learn a fact of it.
SPREAD = 16
#: Names of sets that a task remembers so as to send equal sets once (some 25 MB); the index drops the repeats that are left.
SEEN = 250_000
_U = np.uint64


def _ceil(a, b):
    return -(-a // b)


def least_overlap(m, n, percent: int = PERCENT):
    """The smallest overlap of sets of these sizes that links them."""
    return _ceil(percent * (m + n), percent + 100)


def probe_length(n, percent: int = PERCENT):
    """How many of the rarest shingles of a set meet every smaller or equal set it is linked with."""
    return n - _ceil(percent * n, 100) + 1


def index_length(n, percent: int = PERCENT):
    """How many of them meet every larger or equal set."""
    return n - _ceil(2 * percent * n, percent + 100) + 1


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    b, offsets = textkit.buffer(column)
    starts, ends, at = textkit.words(b, offsets)
    h = textkit.hashes(b, starts, ends)
    for i in range(len(column)):
        yield np.unique(textkit.shingles(h[at[i] : at[i + 1]], width))


def _name(s: np.ndarray, shared: frozenset = frozenset()) -> tuple[int, int]:
    """Two 64-bit names of a set; a first name that different sets share is mixed with the second one."""
    with np.errstate(over="ignore"):
        a = textkit.mix(s).sum(dtype=_U)
        b = textkit.mix(s ^ _U(0x5DEECE66D)).sum(dtype=_U)
    a, b = int(a.astype(np.int64)), int(b.astype(np.int64))
    return (a ^ b if a in shared else a), b


def _bitmap(s: np.ndarray) -> bytes:
    """The parity of the set's members in each of about two bits for each of them."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(a: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap on fewer bits: its parts laid over each other."""
    return np.bitwise_xor.reduce(a.reshape(-1, size), axis=0) if len(a) > size else a


def _apart(a: bytes, b: bytes) -> int:
    """At least so many members lie in just one of the two sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, n) ^ _fold(y, n)).sum())


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed: high planes of small numbers are nearly free."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<BQ", a.dtype.itemsize, len(a)))
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpack(data: bytes) -> list[np.ndarray]:
    n, at, kinds = data[0], 1, []
    for _ in range(n):
        kinds.append(struct.unpack_from("<BQ", data, at))
        at += 9
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:]), np.uint8)
    out, at = [], 0
    for width, size in kinds:
        planes = raw[at : at + width * size].reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view({4: np.uint32, 8: np.uint64}[width]).ravel())
        at += width * size
    return out


def _distinct(column: pa.Array, width: int, seen: set, shared: frozenset = frozenset()) -> Iterator[tuple[int, np.ndarray]]:
    """(name, set) of each set that this task has not met yet; the memory of names is bounded."""
    for s in _sets(column, width):
        if not len(s):
            continue
        name, second = _name(s, shared)
        if (name, second) in seen:
            continue
        if len(seen) >= SEEN:
            seen.clear()
        seen.add((name, second))
        yield name, s


BLOBS = "bucket int, data binary"


def _blobs(buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _split(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted 64-bit keys by their top bits."""
    cuts = np.searchsorted(keys, (np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)))
    edges = [0, *cuts.tolist(), len(keys)]
    return [(i, edges[i], edges[i + 1]) for i in range(1 << bits) if edges[i + 1] > edges[i]]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each bucket of this partition; they stay compressed until their bucket's turn."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(k, []).append(data)
    for k in sorted(held):
        yield k, held.pop(k)


def frequent(docs: DataFrame, width: int, bits: int, hot_keys: int = HOT_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """Keys (top bits of shingle hashes, sorted) and levels (log2 of the number of sets) of the most frequent shingles.

    All shingles of all sets are counted: each task sends its sorted hashes as compressed differences, by bucket.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            low = ((keys << _U(bits)) >> _U(32)).astype(np.uint32)
            parts = _split(keys, bits)
            return _blobs([k for k, _, _ in parts], [_pack(np.diff(low[i:j], prepend=np.uint32(0))) for _, i, j in parts])

        for batch in batches:
            for i, j in textkit.slices(batch):
                for _, s in _distinct(batch.column("text").slice(i, j - i), width, seen):
                    held.append(s)
                    total += len(s)
                if total >= CHUNK:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _gathered(batches):
            low = np.sort(np.concatenate([np.cumsum(_unpack(x)[0], dtype=np.uint32) for x in blobs]))
            first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            n = np.diff(np.r_[first, len(low)])
            keep = n >= HOT_FROM
            keys = (np.int64(bucket) << np.int64(32)) | low[first[keep]].astype(np.int64)
            level = np.log2(n[keep]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(level, pa.int32())], names=["key", "level"])

    counted = cut(
        docs.select("text").mapInArrow(send, BLOBS).repartition(1 << bits, "bucket").mapInArrow(count, "key bigint, level int")
    )
    levels = {r["level"]: r["n"] for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()}  # 64 at most
    total, least = 0, 99
    for level in sorted(levels, reverse=True):
        if (total := total + levels[level]) > hot_keys:
            break
        least = level
    hot = counted.where(F.col("level") >= least).toPandas().sort_values("key")  # hot_keys at most
    return hot["key"].to_numpy(np.int64).astype(_U), hot["level"].to_numpy(np.uint8)


def _entries(docs: DataFrame, width: int, percent: int, bits: int, hot, shared: frozenset, block: int) -> DataFrame:
    """The index: for each chunk of sets and bucket, packed (key, set, place) and the sets' names and sizes.

    Entries of shingles that ``block`` sets or more have go past the buckets, as (list, set, size, place) in blobs of their
    own numbers, from 1 << bits on: their lists are long, and no task is to gather them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = hot.value
        least_level = max(block - 1, 1).bit_length()
        seen: set = set()
        names: list[int] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            counts = [len(x) for x in held]
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), counts)
            place = np.concatenate([np.arange(c, dtype=np.uint32) for c in counts])
            all_names, all_sizes = np.array(names, np.int64).astype(_U), np.array(sizes, np.uint32)
            k = h >> _U(32 - bits)
            far = np.zeros(len(h), bool)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                far = (keys[at] == k) & (levels[at] >= least_level)
            of = owner[far]
            apart = [_pack(k[far], all_names[of], all_sizes[of], place[far])] if far.any() else []
            h, owner, place = h[~far], owner[~far], place[~far]
            order = np.argsort(h, kind="stable")
            h, owner, place = h[order], owner[order], place[order]
            out: list[bytes] = []
            parts = _split(h, bits)
            for _, i, j in parts:
                mine, local = np.unique(owner[i:j], return_inverse=True)
                low = ((h[i:j] << _U(bits)) >> _U(32)).astype(np.uint32)
                out.append(_pack(np.diff(low, prepend=np.uint32(0)), local.astype(np.uint32), place[i:j], all_names[mine], all_sizes[mine]))
            beyond = [(1 << bits) + int(all_names[0] & _U((1 << bits) - 1))] * len(apart)
            return _blobs([b for b, _, _ in parts] + beyond, out + apart)

        total = 0
        for batch in batches:
            for i, j in textkit.slices(batch):
                for name, s in _distinct(batch.column("text").slice(i, j - i), width, seen, shared):
                    n = len(s)
                    if len(keys):
                        k = s >> _U(32 - bits)
                        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                        level = np.where(keys[at] == k, levels[at], 0)
                        if level.any():
                            s = s[np.argsort(level, kind="stable")]
                    names.append(name)
                    sizes.append(n)
                    held.append(s[: probe_length(n, percent)])
                    total += len(held[-1])
                if total >= CHUNK:
                    yield flush()
                    names, sizes, held, total = [], [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(send, BLOBS).repartition(1 << bits, "bucket")


def _possible(n_i, n_j, p_i, p_j, percent):
    """Sizes and places in a common list leave room for a link; the first set is not the larger one."""
    room = np.minimum(p_i, p_j) + 1 + np.minimum(n_i - p_i, n_j - p_j) - 1
    return (100 * n_i >= percent * n_j) & (p_i < index_length(n_i, percent)) & (room >= least_overlap(n_i, n_j, percent))


FOUND = "kind int, a bigint, b bigint, n int, place int, list bigint"


def _found(kind: int, a, b, n=None, place=None, key=None) -> pa.RecordBatch:
    z = np.zeros(len(a), np.int32)
    cols = [z + kind, a, b, z if n is None else n, z if place is None else place, z.astype(np.int64) if key is None else key]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(c).astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)],
        names=[f.split()[0] for f in FOUND.split(", ")],
    )


def _pairs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller name first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _lists(index: DataFrame, percent: int, short: int, bits: int) -> DataFrame:
    """Kind 0: candidate pairs (a, b). Kind 1: the entries (set a, size, place) of lists longer than ``short``, and of those
    that went past the buckets; of the latter, repeats are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _gathered(batches):
            if bucket >= 1 << bits:
                for whole, name, n, place in map(_unpack, blobs):
                    yield _found(1, name.astype(np.int64), name.astype(np.int64), n, place, whole)
                continue
            parts = [_unpack(x) for x in blobs]
            key = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
            name = np.concatenate([p[3][p[1]] for p in parts]).astype(np.int64)
            n = np.concatenate([p[4][p[1]] for p in parts]).astype(np.int64)
            place = np.concatenate([p[2] for p in parts]).astype(np.int64)
            del parts, blobs
            # most keys belong to one set: they leave before the sort
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = key[1:] == key[:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            order, key = order[shared], key[shared]
            name, n, place = name[order], n[order], place[order]
            order = np.lexsort((name, n, key))
            key, name, n, place = key[order], name[order], n[order], place[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])] if len(key) else np.zeros(0, bool)
            key, name, n, place = key[new], name[new], n[new], place[new]
            if len(key) < 2:
                continue
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            brief = np.repeat(size <= short, size)
            got_a, got_b = [], []
            for k in range(1, min(short, int(size.max()))):
                i = np.flatnonzero((key[k:] == key[:-k]) & brief[k:])
                i = i[_possible(n[i], n[i + k], place[i], place[i + k], percent)]
                got_a.append(name[i])
                got_b.append(name[i + k])
            if got_a:
                yield _found(0, *_pairs_of(np.concatenate(got_a), np.concatenate(got_b)))
            long = ~brief
            if long.any():
                whole = (np.int64(bucket) << np.int64(32)) | key[long].astype(np.int64)
                yield _found(1, name[long], name[long], n[long], place[long], whole)

    return index.mapInArrow(run, FOUND)


def _told(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of sets (a) with the one row of ``facts`` for their keys; the rows of a key are dealt over SPREAD tasks."""
    dealt = facts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("_s", F.pmod(F.hash("a"), F.lit(SPREAD))).join(dealt, [*keys, "_s"]).drop("_s")


def _kind(n, percent: int):
    """The class of a set by its size: linked sets are of the same class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("int")


def _stars(long: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b): each set of a long list with the list's leader, and with that of its sets of like size.

    The leader is the set with the most entries in long lists: the one that differs least from the others of a group
    of near copies, as few of its rarest shingles are its own. Degrees and leaders are aggregates, so hot lists are
    combined before they are shuffled.
    """
    e = long.join(long.groupBy("a").agg(F.count("*").alias("degree")), "a")
    out = None
    for keys in (["list"], ["list", "kind"]):
        x = e.withColumn("kind", _kind(F.col("n"), percent))
        lead = x.groupBy(*keys).agg(F.max(F.struct("degree", (-F.col("a")).alias("r"), "a", "n")).alias("lead"))
        x = _told(x, lead.select(*keys, F.col("lead.a").alias("b"), F.col("lead.n").alias("m")), keys)
        x = x.where((F.col("a") != F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
        x = x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        out = x if out is None else out.unionByName(x)
    return out.distinct()


def _odd(entries: DataFrame, every: bool) -> DataFrame:
    """The entries of lists that name several components (all lists, with ``every``), with three facts.

    ``odd``: the set is outside of the list's most frequent component (or ``every`` set is); ``total`` and ``outside``:
    the numbers of entries and of odd ones in the list. All are aggregates, combined before they are shuffled.
    """
    sizes = entries.groupBy("list", "comp").agg(F.count("*").alias("size"))
    top = F.max(F.struct("size", "comp"))
    facts = sizes.groupBy("list").agg(top.alias("top"), F.count("*").alias("comps"), F.sum("size").alias("total"))
    if not every:
        facts = facts.where("comps > 1")
    outside = F.col("total") if every else F.col("total") - F.col("top.size")
    out = _told(entries, facts.select("list", F.col("top.comp").alias("main"), "total", outside.alias("outside")), ["list"])
    return out.withColumn("odd", F.lit(True) if every else F.col("comp") != F.col("main")).drop("main")


def _blocks(entries: DataFrame, percent: int, block: int) -> DataFrame:
    """Entries dealt into groups (grp) in which those of role 1 or 2 are held against those of role 0 or 2.

    A list of ``block`` entries at most is one group. A longer one is cut into blocks by size class and by hash; its odd
    sets are cut by hash likewise, and each such part meets the blocks of its own class and of the neighbouring ones: any
    two sets that can be linked meet in one group, which holds about twice ``block`` entries at most.
    """
    part = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    own = lambda n, seed: F.pmod(F.xxhash64("a", F.lit(seed)), n.cast("long")).cast("int")
    at = lambda kind, row, col, role: F.struct(
        F.xxhash64("list", kind, row, col).alias("grp"), F.lit(role).alias("role")
    )
    x = entries.withColumns({"_k": _kind(F.col("n"), percent), "_r": part(F.col("total")), "_c": part(F.col("outside"))})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    lies = F.transform(upto("_c"), lambda c: at(F.col("_k"), own(F.col("_r"), 1), c, 0))
    kinds = F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1)
    asks = F.flatten(F.transform(kinds, lambda k: F.transform(upto("_r"), lambda r: at(k, r, own(F.col("_c"), 2), 1))))
    whole = F.array(F.struct(F.col("list").alias("grp"), F.when(F.col("odd"), 2).otherwise(0).alias("role")))
    to = F.when(F.col("_r") == 1, whole).when(F.col("odd"), F.concat(lies, asks)).otherwise(lies)
    return x.select("a", "n", "place", "comp", "odd", "bitmap", F.explode(to).alias("to")).select("to.*", "a", "n", "place", "comp", "odd", "bitmap")


class Answers:
    """Which sets of a block leave room for a link with one of them, by the distances of their bitmaps.

    The distances from the last sets that were held against the block are kept. A set at distance d from one of these has
    the same distances up to d, by the triangle inequality: where that tells on which side of the bound a distance lies,
    the answer is taken over from the similar set's, and only the others are computed. The answers are those that
    computing all would give. ``own`` holds the bitmaps of each width; ``row`` tells a set's place there.
    """

    def __init__(self, n: np.ndarray, width: np.ndarray, row: np.ndarray, own: dict[int, np.ndarray], percent: int):
        self.n, self.width, self.row, self.percent = n, width, row, percent
        self.maps = {(w, w): x for w, x in own.items()}
        self.kept: dict[int, list[tuple[int, np.ndarray]]] = {w: [] for w in own}
        self.computed = 0

    def _on(self, w: int, fewer: int) -> np.ndarray:
        if (w, fewer) not in self.maps:
            x = self.maps[w, w]
            self.maps[w, fewer] = np.bitwise_xor.reduce(x.reshape(len(x), -1, fewer), axis=1)
        return self.maps[w, fewer]

    def _apart(self, i: int, j: np.ndarray) -> np.ndarray:
        """The distances between set ``i`` and the sets ``j``, each on the narrower of two bitmaps."""
        out, own = np.zeros(len(j), np.int64), int(self.width[i])
        widths = self.width[j]
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            fewer = min(w, own)
            out[at] = np.bitwise_count(self._on(w, fewer)[self.row[j[at]]] ^ self._on(own, fewer)[self.row[i]]).sum(axis=1, dtype=np.int64)
        self.computed += len(j)
        return out

    def _room(self, i: int, j: np.ndarray) -> np.ndarray:
        return self.n[j] + self.n[i] - 2 * least_overlap(self.n[j], self.n[i], self.percent)

    def of(self, i: int, j: np.ndarray) -> np.ndarray:
        """Those of the sets ``j`` that set ``i`` may be linked with."""
        room = self._room(i, j)
        # of one width only: a similar set's distances are then measured on the same bytes as the set's own
        kept = self.kept[int(self.width[i])]
        if kept and len(j) > len(kept):
            like = np.array([p for p, _ in kept])
            d = self._apart(i, like)
            best = int(d.argmin())
            if d[best] <= self._room(i, like[best : best + 1])[0]:
                seen = kept[best][1][j]
                near = (seen >= 0) & (seen + d[best] <= room)
                unknown = np.flatnonzero((seen < 0) | (~near & (seen - d[best] <= room)))
                if 2 * len(unknown) <= len(j):
                    near[unknown] = self._apart(i, j[unknown]) <= room[unknown]
                    return j[near]
        apart = self._apart(i, j)
        seen = np.full(len(self.n), -1, np.int32)
        seen[j] = apart
        kept.append((i, seen))
        del kept[:-KEPT]
        return j[apart <= room]


def _second_round(entries: DataFrame, percent: int, every: bool) -> DataFrame:
    """Candidate pairs of long lists whose components differ (or all, with ``every``), if their bitmaps leave room.

    ``entries``: grp, role, a, n, place, comp, odd, bitmap. The list's most frequent component needs no pairs within it, so
    the work grows with the other sets' number times the length of their blocks.
    """

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("a", "n", "place", "comp", "role")
        name, n, place, comp, role = (np.concatenate([np.asarray(b.column(c)) for b in parts]).astype(np.int64) for c in columns)
        strange = np.concatenate([b.column("odd").to_numpy(zero_copy_only=False) for b in parts]).astype(bool)
        maps = pa.chunked_array([b.column("bitmap") for b in parts])
        order = np.lexsort((name, place, n))
        name, n, place, comp, role, strange = (x[order] for x in (name, n, place, comp, role, strange))
        width = np.asarray(pc.binary_length(maps).combine_chunks())[order]
        row, own = np.zeros(len(n), np.int64), {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            row[at] = np.arange(len(at))
            own[w] = np.stack([np.frombuffer(maps[k].as_buffer(), np.uint8) for k in order[at].tolist()])
        answers = Answers(n, width, row, own, percent)
        asks, lies = np.flatnonzero(role > 0), role != 1
        if not len(asks) or not lies.any():
            return
        size = np.unique(n)
        at_place = (n << 32) | place  # sorted
        got_a: list[np.ndarray] = []
        got_b: list[np.ndarray] = []
        held = 0
        for i in asks.tolist():
            m = size[np.searchsorted(size, _ceil(percent * n[i], 100)) : np.searchsorted(size, n[i] * 100 // percent, side="right")]
            # of each size, only the places that leave room for a link are looked at
            need = least_overlap(n[i], m, percent)
            low = np.searchsorted(at_place, (m << 32) | np.maximum(need - n[i] + place[i], 0))
            high = np.searchsorted(at_place, (m << 32) | np.clip(place[i] + m - need, -1, (1 << 32) - 2) + 1)
            count = np.maximum(high - low, 0)
            j = np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)
            # two odd sets meet twice: the one with the smaller name asks
            j = j[lies[j] & (name[j] != name[i]) & (~strange[j] | (name[j] > name[i]))]
            small, large = np.minimum(i, j), np.maximum(i, j)
            ok = _possible(n[small], n[large], place[small], place[large], percent)
            if not every:
                ok &= comp[j] != comp[i]
            k = answers.of(i, j[ok])
            got_a.append(name[k])
            got_b.append(np.full(len(k), name[i]))
            held += len(k)
            if held >= CHUNK:
                yield _found(0, *_pairs_of(np.concatenate(got_a), np.concatenate(got_b)))
                got_a, got_b, held = [], [], 0
        if got_a:
            yield _found(0, *_pairs_of(np.concatenate(got_a), np.concatenate(got_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            key = np.asarray(batch.column("grp"))
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if key[i] != now and held:
                    yield from work(held)
                    held = []
                now = key[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield from work(held)

    return entries.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, FOUND).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, with their exact overlap."""
    x = classes.select(F.col("fp1").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("bitmap_a"))
    y = classes.select(F.col("fp1").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("bitmap_b"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_a, n_b, p, q = (b.column(c).to_pylist() for c in ("n_a", "n_b", "bitmap_a", "bitmap_b"))
            ok = [_apart(s, t) <= m + n - 2 * least_overlap(m, n, percent) for m, n, s, t in zip(n_a, n_b, p, q, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    near = cut(pairs.distinct().join(x, "a").join(y, "b").mapInArrow(bound, "a bigint, b bigint"))
    asked = near.select(F.col("a").alias("fp1")).unionByName(near.select(F.col("b").alias("fp1"))).distinct()
    asked = classes.join(asked, "fp1").select("fp1", F.col("rep.doc_id").alias("_d"), F.col("rep.th").alias("_t"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = texts.join(asked, texts.doc_id.eqNullSafe(asked["_d"]) & (texts.th == asked["_t"])).select("fp1", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in textkit.slices(b):
                part = b.slice(i, j - i)
                data = [s.tobytes() for s in _sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("fp1"), pa.array(data, pa.binary())], names=["fp1", "members"])

    members = texts.mapInArrow(sets, "fp1 bigint, members binary").groupBy("fp1").agg(F.first("members").alias("members"))
    left = members.select(F.col("fp1").alias("a"), F.col("members").alias("s"))
    right = members.select(F.col("fp1").alias("b"), F.col("members").alias("t"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, overlap = [], []
            for s, t in zip(b.column("s"), b.column("t"), strict=True):
                s, t = np.frombuffer(s.as_buffer(), _U), np.frombuffer(t.as_buffer(), _U)
                k = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(k >= least_overlap(len(s), len(t), percent))
                overlap.append(k)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(overlap, pa.int64())], names=["a", "b", "overlap"])
            yield out.filter(pa.array(ok, pa.bool_()))

    return cut(near.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(verify, "a bigint, b bigint, overlap bigint"))


#: Links of one task while components are found.
LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that a link names; comp is the smallest node it reaches.

    Large and small stars in turn: every round moves links to smaller neighbours, with minima combined before the
    shuffle, until nothing moves; the number of rounds grows with the logarithm of the longest path.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        # a round has several exchanges, and each leaves files for every task: the tasks follow the number of links
        few = lambda df, n=max(1, now[0] // LINKS): df.coalesce(n)
        edges = few(edges)
        both = few(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = few(few(both.join(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(least, "u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(few(few(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct()))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def named(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, th, n, fp1, fp2, bitmap) of every row: the size and names of its set."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in textkit.slices(b):
                part = b.slice(i, j - i)
                n, one, two, bitmap = [], [], [], []
                for s in _sets(part.column("text"), width):
                    x, y = _name(s) if len(s) else (0, 0)
                    n.append(len(s))
                    one.append(x)
                    two.append(y)
                    bitmap.append(_bitmap(s) if len(s) else None)
                cols = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bitmap, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *cols], names=["doc_id", "th", "n", "fp1", "fp2", "bitmap"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return cut(rows.mapInArrow(run, "doc_id bigint, th bigint, n bigint, fp1 bigint, fp2 bigint, bitmap binary"))


def _unmixed(names: DataFrame) -> tuple[DataFrame, frozenset]:
    """``names`` in which different sets have different first names, and the first names that had to change.

    Of n sets about n * n / 2**65 share one by chance (three of 10**10): so many come to the driver.
    """
    second = F.struct("fp2", "n")
    both = names.where("n > 0").groupBy("fp1").agg(F.min(second).alias("p"), F.max(second).alias("q")).where("p <> q")
    shared = frozenset(r.fp1 for r in both.select("fp1").collect())
    if shared:
        names = names.withColumn("fp1", F.when((F.col("n") > 0) & F.col("fp1").isin(*shared), F.col("fp1").bitwiseXOR(F.col("fp2"))).otherwise(F.col("fp1")))
    return names, shared


def _bits(names: DataFrame) -> int:
    """The index has 1 << bits buckets: as many as shuffle partitions, and more for more than BUCKET shingles in each."""
    total = names.agg(F.sum("n")).first()[0] or 0
    least = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(4, (max(least, total // BUCKET) - 1).bit_length()), 16)


def links(
    docs: DataFrame,
    names: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    every: bool = False,
    shared: frozenset | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Links (a, b, overlap) between classes, named by fp1: enough to connect every component, or ``every`` one.

    ``names``: what ``named`` has returned, or, with ``shared``, what ``_unmixed`` has."""
    done, _, more = _rounds(docs, names, width, percent, every, shared, block)
    return done if more is None else done.unionByName(more)


def _rounds(docs, names, width, percent, every, shared, block) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The links of the first round, the components (a, comp) that they make, and the links of the second round.

    Without long lists there is no second round: the last two are None."""
    spark = ship(docs.sparkSession)
    bits = _bits(names)
    if shared is None:
        names, shared = _unmixed(names)
    some = names.where("n > 0").groupBy("fp1", "fp2", "n")
    classes = some.agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bitmap").alias("bitmap"))
    hot = spark.sparkContext.broadcast(frequent(docs, width, bits))
    found = cut(_lists(_entries(docs, width, percent, bits, hot, shared, block), percent, SHORT, bits))
    first = found.where("kind = 0").select("a", "b")
    long = cut(found.where("kind = 1").select("list", "a", "n", "place").distinct())
    if long.isEmpty():
        return _verified(first, classes, docs, width, percent), None, None
    first = cut(first.unionByName(_stars(long, percent)).distinct())
    done = _verified(first, classes, docs, width, percent)
    comp = components(done).withColumnRenamed("node", "a")
    labelled = long.join(comp, "a", "left").select("list", "a", "n", "place", F.coalesce("comp", "a").alias("comp"))
    odd = _odd(labelled, every).join(classes.select(F.col("fp1").alias("a"), "bitmap"), "a")
    more = _second_round(_blocks(odd, percent, block), percent, every).distinct().join(first, ["a", "b"], "left_anti")
    return done, comp, _verified(more, classes, docs, width, percent)


def _classes(docs: DataFrame, width: int, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The named rows, and for each set (fp1) its component and the component's first row: least (no_id, id, th)."""
    names, shared = _unmixed(named(docs, width))
    done, comp, more = _rounds(docs, names, width, percent, False, shared, block)
    # the first round's components stand for its links: only the second round's are new
    comp = components(done if comp is None else comp.select("a", F.col("comp").alias("b")).unionByName(more.select("a", "b")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "th")).alias("least")
    sets = names.where("n > 0").groupBy("fp1").agg(first)
    tree = sets.join(comp, sets.fp1 == comp.node, "left").select("fp1", "least", F.coalesce("comp", "fp1").alias("comp"))
    return names, tree.select("fp1", "comp").join(tree.groupBy("comp").agg(F.min("least").alias("least")), "comp")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, n_shingles, component_id) of every row of ``docs``."""
    names, of = _classes(docs, width, percent, block)
    of = of.select(F.col("fp1").alias("_f"), F.col("least.id").alias("component_id"))
    out = names.join(of, (names.fp1 == of["_f"]) & (names.n > 0), "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component stays: that with the smallest id, then the smallest hash of its text.

    Rows without a set all stay; a row without an id stays only if no row of its component has one."""
    _, of = _classes(docs.select("doc_id", "text"), width, percent)
    d, n, t = unused(docs, "_d", "_n", "_t")
    keys = lambda i, h: (F.coalesce(i, F.lit(0)).alias(d), i.isNull().alias(n), h.alias(t))
    keep = of.select("least.*").distinct().select(*keys(F.col("id"), F.col("th")))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(has_words).select("*", *keys(F.col("doc_id"), F.xxhash64("text")))
    kept = rows.join(keep, [d, n, t], "left_semi").dropDuplicates([d, n, t])
    return kept.drop(d, n, t).unionByName(docs.where(~has_words))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g, least(len(w), 5) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
