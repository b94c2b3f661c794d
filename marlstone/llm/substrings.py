"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that starts anywhere else too.

Every stretch of ``length`` bytes has an anchor: the short string in it whose hash is the least (winnowing), so two equal
stretches have the same anchor at the same place. Anchors carry a hash of all that the stretches they are the anchor of
reach. Instances that agree on both sides are repeated as a whole; that is settled by
counting, combined before the shuffle. Where instances of an anchor agree only in part, their surroundings are brought
together, cut into blocks where any two of them part, and the blocks' strings are put in suffix order (linear grouping,
see ``suffixes``); each one's longest common prefix with its neighbours gives to the byte how far a repeat reaches.

An anchor with very many different surroundings is split by where a stretch begins: any repeated stretch agrees on all
that the stretches of its part have in common, so each part is complete in itself. Instances that agree on all that a
part reaches are settled by counting; parts that are still too large are split again, down to a single stretch.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; matches never cross documents;
repeated rows are repeats of each other; rows that share an id but not a text are apart; an empty table gives an
empty result. Offsets are bytes of UTF-8; cut texts are binary, since a cut may fall within a character.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import suffixes, textkit
from marlstone.llm.store import cut, written
from marlstone.session import ship

LENGTH = 400
ANCHOR = 32
#: Anchors with more different surroundings than this are split by the windows that hold them, until no group has more.
SPLIT_OVER = 2_000
#: Parts into which the windows of a group are split at a time.
WAYS = 4
#: Up to so many anchors with many surroundings (some 60 bytes each) go to the texts by broadcast.
BROADCAST_ANCHORS = 100_000
#: Block symbols that are put in suffix order at a time (more if one anchor has more).
SYMBOLS = 50_000
_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_RINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = _U((1 << 24) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[_U(1), np.full(n, base, _U)], dtype=_U)


_tables: dict = {}


def _tables_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 21, 1 << int(n).bit_length())
    if _tables.get("n", 0) < size:
        _tables.update(n=size, up=_powers(_R, size), down=_powers(_RINV, size))
    return _tables["up"], _tables["down"]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    y = np.full(blocks * w, np.iinfo(np.uint64).max, _U)
    y[: len(x)] = x
    y = y.reshape(blocks, w)
    fore = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def anchors(b: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """Places of the anchors in a buffer of several texts, where the stretches they are the anchor of begin and end, and
    hashes of each anchor and of all that those stretches hold.

    Texts beyond 2**24 bytes are taken in overlapping parts, so that places fit beside the hashes.
    """
    n = len(b)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, *(np.zeros(0, _U),) * 2
    up, down = _tables_of(n)
    with np.errstate(over="ignore"):
        total = np.r_[_U(0), np.cumsum(textkit._BYTE[b] * up[:n], dtype=_U)]

        def piece(s: np.ndarray, e: np.ndarray) -> np.ndarray:
            return textkit.mix(((total[e] - total[s]) * down[s]) ^ (e - s).astype(_U))

        at = np.arange(n - k + 1)
        h = piece(at, at + k)
    w = length - k + 1
    limit = (1 << 24) - 1
    found, starts = [], []
    for lo in range(0, n, limit - length + 1):
        part = h[lo : min(lo + limit - k + 1, len(h))]
        if len(part) < w:
            break
        packed = (part & ~_LOW) | np.arange(len(part), dtype=_U)
        least = (_window_min(packed, w) & _LOW).astype(np.int64) + lo
        # windows that lie within one text
        start = np.arange(lo, lo + len(least))
        some = start + length <= offsets[np.searchsorted(offsets, start, side="right")]
        found.append(least[some])
        starts.append(start[some])
    place, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, starts))
    # the windows of an anchor follow each other
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    end = start[np.r_[first[1:], len(place)] - 1] + length if len(place) else start
    place, start = place[first], start[first]
    return place, start, end, h[place], textkit.mix(piece(start, place) + textkit.mix(piece(place, end)))


ANCHORS = "doc_id bigint, th bigint, place bigint, start bigint, end bigint, anchor bigint, around bigint"


def _anchored(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch):
                part = batch.slice(i, j - i)
                b, offsets = textkit.buffer(part.column("text"))
                place, start, end, h, around = anchors(b, offsets, length, k)
                text = np.searchsorted(offsets, place, side="right") - 1
                index = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(index), part.column("th").take(index)]
                    + [pa.array(x - offsets[text]) for x in (place, start, end)]
                    + [pa.array(x.astype(np.int64)) for x in (h, around)],
                    names=[f.split()[0] for f in ANCHORS.split(", ")],
                )

    return docs.mapInArrow(run, ANCHORS)


#: Rows of a group: windows that begin ``least`` to ``least + room`` bytes before the anchor are open, all members agree
#: on what every such window holds, and ``before`` and ``behind`` are the bytes beyond that (``room`` at most).
SIDES = "grp bigint, kind bigint, copies bigint, doc_id bigint, th bigint, place bigint, least int, room int, before binary, behind binary"
REGIONS = "doc_id bigint, th bigint, start bigint, end bigint"


def _hash(*parts: bytes) -> int:
    d = hashlib.blake2b(digest_size=8)
    for x in parts:
        d.update(len(x).to_bytes(4, "little"))
        d.update(x)
    return int.from_bytes(d.digest(), "little", signed=True)


def _rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=[f.split()[0] for f in SIDES.split(", ")])


def _sides(asked: DataFrame, length: int, k: int) -> DataFrame:
    """The bytes around each asked anchor; ``asked`` has the text of its document and an array of anchors in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch):
                rows: list[list] = [[] for _ in range(10)]
                part = batch.slice(i, j - i)
                for name, th, text, places in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text", "asked")), strict=True):
                    data = (text or "").encode()
                    for a in places:
                        p = a["place"]
                        left, right = data[a["start"] : p], data[p + k : a["end"]]
                        for c, v in enumerate((a["anchor"], 0, a["copies"], name, th, p, 0, length - k, left, right)):
                            rows[c].append(v)
                yield _rows(rows)

    return asked.mapInArrow(run, SIDES)


def _parts(key: int, room: int, left: bytes, right: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(group, kind, least, room, before, behind) of each part of an instance's windows that it has a window in.

    The instance's windows are those that ``left`` and ``right`` hold: its own, as far as the part above reaches. A window
    that begins ``x`` bytes further out holds x bytes of ``left`` and room - x of ``right``. The windows of a
    part share what its widest and narrowest ends have in common: that is its group. Its kind is all that they reach.
    """
    step = -(-(room + 1) // WAYS)
    tag = key.to_bytes(8, "little", signed=True)
    for least in range(0, room + 1, step):
        most = min(room, least + step - 1)
        low, high = max(least, room - len(right)), min(most, len(left))
        if low > high:
            continue
        a, b = len(left), room - most
        group = _hash(tag, least.to_bytes(4, "little"), left[a - least :], right[:b])
        before, behind = left[a - high : a - least], right[b : room - low]
        yield group, _hash(before, behind), least, most - least, before, behind


def _split(sides: DataFrame) -> DataFrame:
    """Each instance once for each part of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                rows: list[list] = [[] for _ in range(10)]
                for g, _, copies, name, th, place, least, room, left, right in zip(*(c.to_pylist() for c in batch.slice(i, 4096).columns), strict=True):
                    for group, kind, more, rest, before, behind in _parts(g, room, left, right):
                        for c, v in enumerate((group, kind, copies, name, th, place, least + more, rest, before, behind)):
                            rows[c].append(v)
                yield _rows(rows)

    return sides.mapInArrow(run, SIDES)


def _bounded(sides: DataFrame, length: int, split_over: int) -> tuple[DataFrame, DataFrame]:
    """Regions (doc_id, th, start, end) and groups of ``split_over`` kinds at most, for instances of large anchors.

    Instances of a group that agree on all that its windows reach are settled by counting, and one of them stays. A
    group that still has too many is split again; parts end at a single window each, where all members agree.
    """
    regions, groups = None, None
    while True:
        rows = written(_split(sides), "parts")
        kinds = rows.groupBy("grp", "kind").agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "th", "place", "least", "room", "before", "behind")).alias("one"))
        kinds = cut(kinds)
        same = rows.where("copies = 1").join(kinds.where("copies > 1").select("grp", "kind"), ["grp", "kind"], "left_semi")
        # an end that the text cuts short is cut short in all of them
        same = same.select(
            "doc_id",
            "th",
            (F.col("place") - F.col("least") - F.length("before")).alias("start"),
            (F.col("place") + length - F.col("least") - F.col("room") + F.length("behind")).alias("end"),
        )
        total = kinds.groupBy("grp").agg(F.count("*").alias("kinds")).where("kinds > 1")
        rest = cut(kinds.join(total, "grp").select("grp", "kind", "copies", "one.*", "kinds"))
        names = [f.split()[0] for f in SIDES.split(", ")]
        few = rest.where(F.col("kinds") <= split_over).select(names)
        regions = same if regions is None else regions.unionByName(same)
        groups = few if groups is None else groups.unionByName(few)
        sides = rest.where(F.col("kinds") > split_over).select(names)
        if sides.isEmpty():
            return regions, groups


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    d = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(d.argmax())


def _reach(sides: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """The order of strings, what each shares with the one before it in that order, and the most that it shares with any.

    What two strings share is the least that neighbours between them share.
    """
    order = sorted(range(len(sides)), key=sides.__getitem__)
    most, shared = [0] * len(sides), [0] * len(sides)
    for i, j in zip(order, order[1:], strict=False):
        n = shared[j] = _common(sides[i], sides[j])
        if n > most[i]:
            most[i] = n
        if n > most[j]:
            most[j] = n
    return order, shared, most


class Blocks:
    """Block strings of several anchors' surroundings, put in suffix order together."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.last = 0
        self.text: list[int] = []
        #: of each instance: owner, place, whether it is one copy, where its anchor stands in the text, its blocks before
        #: the anchor, the distances at which blocks part on both sides, the length of its repeats
        self.strings: list[tuple] = []

    @property
    def symbols(self) -> int:
        return len(self.text)

    def _side(self, order: list[int], shared: list[int], most: list[int]) -> tuple[list[list[int]], np.ndarray]:
        """The blocks of each string, nearest first, and the distances at which any two strings part, from 0.

        A string has the blocks of the one before it in order as far as they agree, and new ones from there on; blocks
        beyond all that it shares cannot be part of a repeat and are left out.
        """
        edges = sorted({0, *shared})
        out: list[list[int]] = [[]] * len(order)
        before: list[int] = []
        for i in order:
            n, k = bisect_right(edges, most[i]) - 1, bisect_right(edges, shared[i]) - 1
            before = out[i] = before[:k] + list(range(self.last + 1, self.last + 1 + n - k))
            self.last += n - k
        return out, np.array(edges)

    def add(self, rows: list[tuple], length: int | None = None) -> None:
        """(copies, owner, place, before, behind) of each instance of one anchor, and the length of its repeats."""
        length = self.length if length is None else length
        # whoever shares too little on both sides together has no repeat here, nor is part of another's
        while True:
            left, right = _reach([r[3][::-1] for r in rows]), _reach([r[4] for r in rows])
            some = [a + b >= length for a, b in zip(left[2], right[2], strict=True)]
            if all(some):
                break
            rows = [r for r, x in zip(rows, some, strict=True) if x]
        if len(rows) < 2:
            return
        (outer, left_edges), (inner, right_edges) = self._side(*left), self._side(*right)
        for (copies, owner, place, _, _), a, b in zip(rows, outer, inner, strict=True):
            self.text += a[::-1]
            self.strings.append((owner, place, copies == 1, len(self.text), len(a), left_edges, right_edges, length))
            self.text += b
            self.text.append(-len(self.strings))  # ends differ from each other and come before all blocks

    def regions(self) -> Iterator[tuple]:
        """(owner, start, end) of the stretch that repeats, for instances that have no full copy.

        All repeats of an instance hold its anchor, so together they are one stretch.
        """
        if not self.text:
            return
        order, rank = suffixes.suffix_array(self.text)
        shared = np.array([*suffixes.common_prefixes(self.text, order, rank), 0])
        rank = np.array(rank)
        same = np.maximum(shared[rank], shared[rank + 1])
        for owner, place, single, at, depth, left, right, length in self.strings:
            if not single:
                continue
            # the suffix that begins t blocks before the anchor
            t = np.arange(depth + 1)
            reach = same[at - t] - t
            t, reach = t[reach >= 0], reach[reach >= 0]
            ok = left[t] + right[reach] >= length
            if ok.any():
                yield owner, place - int(left[t[ok]].max()), place + int(right[reach[ok]].max())


def _partial(sides: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held, now, room = Blocks(length), [], None, 0

        def flush() -> pa.RecordBatch:
            got = list(blocks.regions())
            # what all members of a group agree on lies between
            cols = [[x[0][0] for x in got], [x[0][1] for x in got], [x[1] - x[0][2] for x in got], [x[2] + length - x[0][2] - x[0][3] for x in got]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "th", "start", "end"])

        for batch in batches:
            for g, _, copies, name, th, place, least, room_, before, behind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    if len(held) > 1:
                        blocks.add(held, room)
                        if blocks.symbols >= SYMBOLS:
                            yield flush()
                            blocks = Blocks(length)
                    held, now, room = [], g, room_
                held.append((copies, (name, th, least, room_), place, before, behind))
        if len(held) > 1:
            blocks.add(held, room)
        if blocks.symbols:
            yield flush()

    return sides.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, REGIONS)


#: A row by its id and text; ids may be null.
KEY = ("_d", "_n", "_t")


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("*", F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_n"), F.col("th").alias("_t"))


def repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, split_over: int = SPLIT_OVER) -> DataFrame:
    """(doc_id, th, regions): the repeated stretches of each text that has any, as start << 32 | end, possibly overlapping.

    ``docs`` has doc_id, text and th, a hash of the text.
    """
    ship(docs.sparkSession)
    found = written(_anchored(docs, length, k), "anchors")
    kinds = found.groupBy("anchor", "around").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "place", "start", "end")).alias("one"))
    total = kinds.groupBy("anchor").agg(F.sum("copies").alias("all"), F.count("*").alias("kinds")).where(F.col("all") > 1)
    kinds = cut(kinds.join(total, "anchor"))
    whole = found.join(kinds.where("copies > 1").select("anchor", "around"), ["anchor", "around"], "left_semi")
    whole = whole.select("doc_id", "th", "start", "end")

    def sides(some: DataFrame, few: bool) -> DataFrame:
        """``few``: there are so few that they go to the texts; otherwise both are shuffled."""
        asked = _keyed(some.select("anchor", "copies", "one.*")).groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "copies", "place", "start", "end")).alias("asked"))
        texts = _keyed(docs).join(F.broadcast(asked) if few else asked, list(KEY))
        texts = texts.dropDuplicates(list(KEY)).select("doc_id", "th", "text", "asked")
        return _sides(texts, length, k)

    groups = sides(kinds.where((F.col("kinds") > 1) & (F.col("kinds") <= split_over)), False)
    large = kinds.where(F.col("kinds") > split_over)
    n = large.count()
    if n:
        settled, bounded = _bounded(sides(large, n <= BROADCAST_ANCHORS), length, split_over)
        whole, groups = whole.unionByName(settled), groups.unionByName(bounded)
    part = _partial(groups, length)
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("end"))
    return whole.unionByName(part).groupBy("doc_id", "th").agg(F.collect_set(packed).alias("regions"))


def _runs(regions: np.ndarray, size: int) -> np.ndarray:
    """Maximal runs (start, end) of the union, within the text."""
    regions = np.sort(regions)
    start, end = np.minimum(regions >> 32, size), np.maximum.accumulate(np.minimum(regions & 0xFFFFFFFF, size))
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return np.stack([start[first], end[np.r_[first[1:] - 1, len(end) - 1]]], axis=1)


def cleaned(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, split_over: int = SPLIT_OVER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row: the removed runs and the bytes that stay."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    of = lambda runs, kept: ([{"start": s, "end": e} for s, e in runs], b"".join(kept))
    return _applied(docs, length, k, split_over, "spans array<struct<start:bigint,end:bigint>>, kept binary", of, [span, pa.binary()])


def _applied(docs: DataFrame, length: int, k: int, split_over: int, columns: str, of, kinds) -> DataFrame:
    """``of`` gives further columns from the removed runs of a text and the parts of it that stay."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = _keyed(repeats(rows, length, k, split_over)).select(*KEY, "regions")
    # with th, so that both joins have the same columns of the texts and share one shuffle
    joined = _keyed(rows).join(found, list(KEY), "left").select("doc_id", "th", "text", "regions")
    names = [f.split()[0] for f in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch):
                part = batch.slice(i, j - i)
                b, at = textkit.buffer(part.column("text"))
                data, at = memoryview(b), at.tolist()
                regions = pa.concat_arrays([part.column("regions")])
                values, edges = np.asarray(regions.flatten()), np.r_[0, np.cumsum(regions.value_lengths().fill_null(0))].tolist()
                size, gone, extra = [], [], []
                for r in range(len(part)):
                    lo, hi = at[r], at[r + 1]
                    size.append(hi - lo)
                    if edges[r] == edges[r + 1]:
                        gone.append(0)
                        extra.append(of([], [data[lo:hi]]))
                        continue
                    runs = _runs(values[edges[r] : edges[r + 1]], hi - lo)
                    gone.append(int((runs[:, 1] - runs[:, 0]).sum()))
                    stay = [0, *runs.ravel().tolist(), hi - lo]
                    extra.append(of(runs.tolist(), [data[lo + x : lo + y] for x, y in zip(stay[::2], stay[1::2], strict=True)]))
                cols = [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64())]
                cols += [pa.array([x[c] for x in extra], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", *names])

    return joined.mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, {columns}")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""

    def of(runs: list, kept: list) -> tuple[int, str]:
        d = hashlib.sha256()
        for x in kept:
            d.update(x)
        return len(runs), d.hexdigest()

    return _applied(docs, LENGTH, ANCHOR, SPLIT_OVER, "n_spans bigint, kept_sha256 string", of, [pa.int64(), pa.string()])
