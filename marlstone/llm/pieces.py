"""SentencePiece encoding and decoding with seeded merge-dropout.

A text is cut where no piece of the vocabulary can reach across (a space begins a new run), and each run is merged by
an agenda: candidate merges leave a heap by score, then by place. A candidate is skipped if a keyed hash of (seed,
stream, its place, its piece) falls below ``dropout``; a run of a text has a hash stream of its own by the text and its
ordinal, so every occurrence of a word is cut anew while every run of the job gives the same ids. Without dropout the
ids are those of the model's own encoder. Characters outside the vocabulary, and literal space markers, go to byte
pieces, so decoding gives back every text exactly.

What a run becomes depends only on which of the candidates that its agenda pops are skipped. Each word keeps these
outcomes as a tree: a node is the next candidate, its two branches are taken and skipped, a leaf holds the ids. A batch
of runs walks down its trees together by their own hashes; where a branch is new, the runs are merged together and the
rest of their way is added. The trees are bounded by bytes (``TREE_BYTES``) and begin anew beyond that.

Defined results: a null text gets null ids, an empty text none; null ids decode to null; repeated rows get equal ids;
other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import textkit
from marlstone.llm.columns import others
from marlstone.session import ship

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20240501
#: Hash streams of runs: as many as a text's checksum can tell apart and more.
STREAMS = 1 << 48
TREE_BYTES = 100_000_000
#: Texts are cut into runs in parts of about so many characters.
PART = 1_000_000
#: Longer runs are merged alone with a heap, so that no text costs the square of its length.
SHORT_RUN = 48

SPACE = "▁"
_RUN = re.compile(r" *[^ ]+| +")
_CUT = re.compile(r"(?<=[^ ])(?= )")
_M = (1 << 64) - 1


def _keyed(seed: int, stream: int, place: int, piece: int) -> int:
    """A 64-bit hash of a candidate merge."""
    x = (seed ^ stream * 0x9E3779B97F4A7C15 ^ place * 0xC2B2AE3D27D4EB4F ^ piece * 0x165667B19E3779F9) & _M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M
    return x ^ x >> 31


def _keyed_many(seed: int, stream: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The same hash for many candidates."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = u(seed & _M) ^ stream * u(0x9E3779B97F4A7C15) ^ place.astype(u) * u(0xC2B2AE3D27D4EB4F) ^ piece.astype(u) * u(0x165667B19E3779F9)
        x = (x ^ x >> u(30)) * u(0xBF58476D1CE4E5B9)
        x = (x ^ x >> u(27)) * u(0x94D049BB133111EB)
        return x ^ x >> u(31)


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind) -> None:
        self.room = np.empty(1 << 12, kind)
        self.size = 0

    def add(self, x: np.ndarray) -> int:
        """Appends ``x``; returns where it begins."""
        at = self.size
        if at + len(x) > len(self.room):
            room = np.empty(max(2 * len(self.room), at + len(x)), self.room.dtype)
            room[:at] = self.room[:at]
            self.room = room
        self.room[at : at + len(x)] = x
        self.size = at + len(x)
        return at


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - first, size)


class Pieces:
    """The vocabulary of a BPE model file, with encoding and decoding."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.text: list[str] = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.text[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.of_byte = {v: k for k, v in self.byte.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.rank = {i: -sp.get_score(i) for i in plain}
        self.raw = [bytes((self.byte[i],)) if i in self.byte else x.replace(SPACE, " ").encode() for i, x in enumerate(self.text)]
        self.raw_size = np.array([len(x) for x in self.raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        # of each character; unknown ones, and the literal marker, are negative
        self.first = -1 - np.arange(0x110000, dtype=np.int32)
        for x, i in self.id.items():
            if len(x) == 1 and x != SPACE:
                self.first[ord(x)] = i
        self.first[ord(" ")] = self.id.get(SPACE, -1 - ord(" "))
        self.merges: tuple[np.ndarray, ...] | None = None
        self.forget()

    def forget(self) -> None:
        """Empties the trees."""
        self.words: dict[str, int] = {}  # the slot of each word
        self.slots = Grown(np.int64)  # a node, or -2 - a leaf, or -1 if that way is new
        self.spots = Grown(np.int64)  # of each node, its candidate: place << 32 | piece
        self.ways = Grown(np.int64)  # of each node, the first of its two slots: taken and skipped
        self.ids = Grown(np.int32)
        self.leaves = Grown(np.int64)  # where each leaf's ids begin
        self.sizes = Grown(np.int64)

    def _held(self) -> int:
        return 200 * len(self.words) + sum(x.room.nbytes for x in (self.slots, self.spots, self.ways, self.ids, self.leaves, self.sizes))

    def _merge(self, run: str, dropout: float, seed: int, stream: int) -> tuple[int, ...]:
        part: list[str | None] = [SPACE if c == " " else c for c in run]
        fixed = [c == SPACE for c in run]  # a literal marker never merges
        n = len(part)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        limit = int(dropout * 2.0**64)
        agenda: list[tuple[float, int, int, int]] = []

        def candidate(i: int, j: int) -> tuple[float, int, int, int] | None:
            if fixed[i] or fixed[j]:
                return None
            piece = self.id.get(part[i] + part[j])
            return None if piece is None else (self.rank[piece], i, j, piece)

        for i in range(n - 1):
            if c := candidate(i, i + 1):
                agenda.append(c)
        heapify(agenda)
        while agenda:
            _, i, j, piece = heappop(agenda)
            # stale: one side is gone or has grown since
            if part[i] is None or part[j] is None or after[i] != j or self.id.get(part[i] + part[j]) != piece:
                continue
            if limit and _keyed(seed, stream, i, piece) < limit:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if c := candidate(i, after[i]):
                    heappush(agenda, c)
            if before[i] >= 0 and (c := candidate(before[i], i)):
                heappush(agenda, c)
        out: list[int] = []
        for x, odd in zip(part, fixed, strict=True):
            if x is None:
                continue
            piece = None if odd else self.id.get(x)
            if piece is None:
                out += [self.of_byte[b] for b in x.encode()]
            else:
                out.append(piece)
        return tuple(out)

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (left id, right id) of all merges, with their pieces and the order of those pieces' scores."""
        if self.merges is None:
            n, found = len(self.text), []
            order = {v: k for k, v in enumerate(sorted(set(self.rank.values())))}
            for x, i in self.id.items():
                for k in range(1, len(x)):
                    left, right = self.id.get(x[:k]), self.id.get(x[k:])
                    if left is not None and right is not None:
                        found.append((left * n + right, i, order[self.rank[i]]))
            found.sort()
            self.merges = tuple(np.array(c, np.int64) for c in zip(*found, strict=True))
        return self.merges

    def _merge_many(self, runs: list[str], stream: np.ndarray, dropout: float, seed: int):
        """The ids of many short runs, and the candidates that their agendas pop.

        Every round takes each run's best candidate, to merge it or to skip it. Returns ids and their number for each
        run, then candidates, whether each is skipped, and their number for each run.
        """
        keys, made, order = self._table()
        n, worst = len(self.text), np.iinfo(np.int64).max
        limit = np.uint64(min(int(dropout * 2.0**64), _M))
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        symbol = self.first[np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(runs)), size)
        place = np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size)
        value, piece = np.full(len(symbol), worst), np.zeros(len(symbol), np.int64)

        def look(i: np.ndarray) -> None:
            """The candidate of each of these symbols with the one behind it."""
            value[i] = worst
            i = i[i + 1 < len(symbol)]
            i = i[(owner[i] == owner[i + 1]) & (symbol[i] >= 0) & (symbol[i + 1] >= 0)]
            pair = symbol[i] * n + symbol[i + 1]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = keys[at] == pair
            i, at = i[hit], at[hit]
            piece[i] = made[at]
            value[i] = (order[at] << 24) | place[i]

        look(np.arange(len(symbol)))
        done: list[tuple[np.ndarray, ...]] = []
        met: list[tuple[np.ndarray, ...]] = []
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(value, start)
            length = np.diff(np.r_[start, len(owner)])
            over = best == worst
            if over.any():
                out = np.repeat(over, length)
                done.append((owner[out], place[out], symbol[out]))
                symbol, owner, place, value, piece = (x[~out] for x in (symbol, owner, place, value, piece))
                best, length = best[~over], length[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(value == np.repeat(best, length))
            if dropout:
                skip = _keyed_many(seed, stream[owner[at]], place[at], piece[at]) < limit
            else:
                skip = np.zeros(len(at), bool)
            met.append((owner[at], place[at] << 32 | piece[at], skip))
            value[at[skip]] = worst
            at = at[~skip]
            if len(at):
                symbol[at] = piece[at]
                stay = np.ones(len(symbol), bool)
                stay[at + 1] = False
                at -= np.arange(len(at))  # one symbol has gone for each merge before
                symbol, owner, place, value, piece = (x[stay] for x in (symbol, owner, place, value, piece))
                before = at[at > 0] - 1
                look(np.concatenate([at, before[owner[before] == owner[before + 1]]]))
        owner, place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        sort = np.lexsort((place, owner))
        owner, symbol = owner[sort], symbol[sort]
        if (symbol < 0).any():
            odd = [[self.of_byte[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")] for x in symbol[symbol < 0].tolist()]
            count = np.ones(len(symbol), np.int64)
            count[symbol < 0] = [len(x) for x in odd]
            owner, symbol = np.repeat(owner, count), np.repeat(symbol, count)
            symbol[symbol < 0] = [y for x in odd for y in x]
        if met:
            who, spot, skip = (np.concatenate(x) for x in zip(*met, strict=True))
            sort = np.argsort(who, kind="stable")
            who, spot, skip = who[sort], spot[sort], skip[sort]
        else:
            who, spot, skip = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return symbol.astype(np.int32), np.bincount(owner, minlength=len(runs)), spot, skip, np.bincount(who, minlength=len(runs))

    def _grow(self, slot: np.ndarray, depth: np.ndarray, merged) -> np.ndarray:
        """Adds the ways of merged runs, each new from its slot at its depth on; returns their leaves."""
        ids, size, spot, skip, popped = merged
        leaf = self.leaves.add(self.ids.add(ids) + np.cumsum(size) - size) + np.arange(len(slot))
        self.sizes.add(size)
        more = popped - depth
        take = _ranges(np.cumsum(popped) - popped + depth, more)
        way = self.slots.size + 2 * np.arange(len(take))
        self.slots.add(np.full(2 * len(take), -1, np.int64))
        node = self.spots.add(spot[take]) + np.arange(len(take))
        self.ways.add(way)
        table, first = self.slots.room, np.cumsum(more) - more
        some = more > 0
        table[slot] = -2 - leaf
        table[slot[some]] = node[first[some]]
        behind = way + skip[take]
        last = (first + more - 1)[some]
        inner = np.ones(len(take), bool)
        inner[last] = False
        table[behind[inner]] = node[inner] + 1
        table[behind[last]] = -2 - leaf[some]
        return leaf

    def _leaves(self, runs: list[str], stream: np.ndarray, dropout: float, seed: int) -> np.ndarray:
        """The leaf of each run; runs over ``SHORT_RUN`` get one of their own."""
        limit = np.uint64(min(int(dropout * 2.0**64), _M))
        get, words = self.words.get, self.words
        slot = list(map(get, runs))
        new: dict[str, int] = {}
        long = []
        if None in slot:
            free = self.slots.size
            for k, s in enumerate(slot):
                if s is None:
                    x = runs[k]
                    if len(x) > SHORT_RUN:
                        slot[k] = -1
                        long.append(k)
                    else:
                        slot[k] = new.setdefault(x, free + len(new))
            words.update(new)
            self.slots.add(np.full(len(new), -1, np.int64))
        at = np.array(slot, np.int64)
        leaf, depth = np.full(len(runs), -1, np.int64), np.zeros(len(runs), np.int64)
        left = np.flatnonzero(at >= 0)
        for turn in range(1 << 30):
            live = left
            while len(live):
                to = self.slots.room[at[live]]
                leaf[live] = -2 - to  # -1 where the way is new
                live, to = live[to >= 0], to[to >= 0]
                spot = self.spots.room[to]
                skip = _keyed_many(seed, stream[live], spot >> 32, spot & 0xFFFFFFFF) < limit if dropout else 0
                at[live] = self.ways.room[to] + skip
                depth[live] += 1
            left = left[leaf[left] < 0]
            if not len(left):
                break
            # one run for each new way, since others often go the same way on; later all that are left
            one = left[np.unique(at[left], return_index=True)[1]]
            for k in range(0, len(one), 20_000):
                part = one[k : k + 20_000]
                leaf[part] = self._grow(at[part], depth[part], self._merge_many([runs[i] for i in part.tolist()], stream[part], dropout, seed))
            left = left[leaf[left] < 0]
        for k in long:
            ids = np.array(self._merge(runs[k], dropout, seed, int(stream[k])), np.int32)
            leaf[k] = self.leaves.add(np.array([self.ids.add(ids)], np.int64))
            self.sizes.add(np.array([len(ids)]))
        return leaf

    def encode_flat(self, texts: list[str], dropout: float = DROPOUT, seed: int = SEED, streams: int = STREAMS) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        out: list[np.ndarray] = []
        size = np.zeros(len(texts), np.int64)
        runs: list[str] = []
        owner: list[tuple[int, int]] = []
        drawn: list[np.ndarray] = []
        total = 0

        def work() -> None:
            nonlocal runs, owner, drawn, total
            if not runs:
                return
            if self._held() > TREE_BYTES:
                self.forget()
            leaf = self._leaves(runs, np.concatenate(drawn), dropout, seed)
            count = self.sizes.room[leaf]
            out.append(self.ids.room[_ranges(self.leaves.room[leaf], count)])
            edges = np.cumsum([n for _, n in owner])
            each = np.diff(np.r_[0, np.cumsum(count)[edges - 1]])
            np.add.at(size, [k for k, _ in owner], each)
            runs, owner, drawn, total = [], [], [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            draw = np.uint64(zlib.crc32(text.encode()) ^ seed & 0xFFFFFFFF)
            text, i, ordinal = " " + text, 0, 0
            while i < len(text):
                m = _CUT.search(text, i + PART)
                j = m.start() if m else len(text)
                found = _RUN.findall(text, i, j)
                runs += found
                owner.append((k, len(found)))
                place = np.arange(ordinal, ordinal + len(found), dtype=np.uint64)
                drawn.append(((place + draw) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(streams))
                ordinal += len(found)
                total += j - i
                i = j
                if total >= PART:
                    work()
        work()
        return np.concatenate(out) if out else np.zeros(0, np.int32), size

    def encode_many(self, texts: list[str], dropout: float = DROPOUT, seed: int = SEED, streams: int = STREAMS) -> list[list[int]]:
        """The ids of each text."""
        ids, size = self.encode_flat(texts, dropout, seed, streams)
        return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if texts else []

    def encode(self, text: str, dropout: float = DROPOUT, seed: int = SEED, streams: int = STREAMS) -> list[int]:
        return self.encode_many([text], dropout, seed, streams)[0]

    def decode_flat(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts in one array, and the number of bytes of each, from ids and their numbers."""
        n = self.raw_size[ids]
        data = self.raw_bytes[_ranges(self.raw_start[ids], n)]
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(size)]]
        length = np.diff(ends)
        # the space that every text begins with goes
        return np.delete(data, ends[:-1][length > 0]), np.maximum(length - 1, 0)

    def decode(self, ids) -> str:
        return b"".join(self.raw[i] for i in ids)[1:].decode()


_loaded: dict = {}


def pieces(model: str = MODEL, dropout: float = 0.0, seed: int = 0) -> Pieces:
    """One vocabulary, and one cache of runs, for each worker process and setting."""
    key = (model, dropout, seed)
    if key not in _loaded:
        if "/" in model:
            path = model
        else:
            import public_tokenizers

            path = public_tokenizers.path(model)
        _loaded[key] = Pieces(path)
    return _loaded[key]


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, streams: int = STREAMS, batch_bytes: int = 2_000_000) -> DataFrame:
    """``docs`` with ``ids``, as they are read, without a shuffle."""
    ship(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in others(docs, "ids")))
    schema = T.StructType(list(docs.schema.fields)).add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, dropout, seed)
        for whole in batches:
            for i, j in textkit.slices(whole, "text", batch_bytes):
                b = whole.slice(i, j - i)
                texts = b.column("text").to_pylist()
                ids, size = p.encode_flat(texts, dropout, seed, streams)
                at = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(ids))], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str = MODEL, batch_rows: int = 256) -> DataFrame:
    """``coded`` with ``decoded``, the texts of its ids."""
    ship(coded.sparkSession)
    coded = coded.select(*(F.col(f"`{c}`") for c in others(coded, "decoded")))
    schema = T.StructType(list(coded.schema.fields)).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for whole in batches:
            for i in range(0, whole.num_rows, batch_rows):
                b = whole.slice(i, batch_rows)
                ids = b.column("ids").cast(pa.large_list(pa.int64()))
                none = np.asarray(ids.is_null())
                data, size = p.decode_flat(np.asarray(ids.flatten()), np.asarray(ids.value_lengths().fill_null(0)))
                at = np.r_[0, np.cumsum(size)].astype(np.int64)
                mask = pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
                out = pa.Array.from_buffers(pa.large_string(), len(none), [mask, pa.py_buffer(at), pa.py_buffer(data)])
                out.validate(full=True)
                yield pa.RecordBatch.from_arrays([*b.columns, out.cast(pa.string())], names=[*b.schema.names, "decoded"])

    return coded.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of ids, a hash of them, and whether they decode to the text."""
    d = decode(encode(docs.select("doc_id", "text")))
    return d.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
