"""Byte-level BPE ids of many texts: cuts in numpy, each distinct cut encoded once by the tokenizers library.

The library cuts a text by one fixed pattern before it merges bytes, and no merge crosses a cut. Here the cuts of a
whole batch are found with array operations over its code points, each cut is known by a 64-bit hash, and only cuts
that this worker has not met go to the library. Texts with characters outside the plain scripts, or with the strings
of special tokens, go to the library whole, so ids are always its own.
"""

from __future__ import annotations

import json

import numpy as np

from marlstone.llm.textkit import mix

#: Code points below this have had the same categories in every Unicode version.
PLAIN = 0x530
CACHE = 1_500_000
_U = np.uint64
_LETTER, _NUMBER, _OTHER, _WHITE = 0, 1, 2, 3


def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(PLAIN + 1, _OTHER, np.uint8)
    for c in range(PLAIN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _WHITE
    return out


class Encoder:
    """One tokenizer and its cache of cuts, for one worker process."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        pre = made.get("pre_tokenizer") or {}
        #: Other pipelines than plain byte-level BPE are left to the library altogether.
        self.known = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer")
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.classes = _classes()
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, keys: list[int], cuts: list[str]) -> None:
        """Cuts of a space and letters go to the library many at a time, with line ends between them: a line end is a
        cut by itself and no part of such a cut, so its id parts their ids again. The others go one by one."""
        word = [len(x) > 1 and x[0] == " " and self.classes[min(ord(x[1]), PLAIN)] == _LETTER for x in cuts] if self.line else [False] * len(cuts)
        words = [i for i, w in enumerate(word) if w]
        lines = ["\n".join(cuts[i] for i in words[j : j + 256]) + "\n" for j in range(0, len(words), 256)]
        found = self.library.encode_batch_fast(lines, add_special_tokens=False)
        flat = np.concatenate([np.asarray(e.ids, np.uint32) for e in found]) if found else np.zeros(0, np.uint32)
        stop = flat == np.uint32(self.line or 0)
        self._store([keys[i] for i in words], flat[~stop], np.diff(np.r_[-1, np.flatnonzero(stop)]) - 1)
        rest = [i for i, w in enumerate(word) if not w]
        ids = [e.ids for e in self.library.encode_batch_fast([cuts[i] for i in rest], add_special_tokens=False)]
        self._store([keys[i] for i in rest], np.array([x for y in ids for x in y], np.uint32), np.array([len(y) for y in ids], np.int64))

    def _store(self, keys: list[int], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.at), len(keys)
        while n + m > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[n : n + m] = sizes
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.at.update(zip(keys, range(n, n + m), strict=True))

    def _cuts(self, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of all cuts; ``c`` the code points of texts, ``first`` the starts of those that are not empty."""
        n = len(c)
        k = self.classes[np.minimum(c, PLAIN)]
        white = k == _WHITE
        head = np.zeros(n, bool)
        head[first] = True
        tail = np.zeros(n, bool)  # the last place of a text
        tail[first[1:] - 1] = True
        tail[-1] = True
        start = head.copy()
        start[1:] |= k[1:] != k[:-1]
        # the last of some white space goes with what follows if it is a space, else it stands alone
        before = np.zeros(n, bool)
        before[:-1] = white[:-1] & ~white[1:]
        before &= ~tail
        start |= before
        behind = np.flatnonzero(before & (c == 32)) + 1
        start[behind] = False
        # contractions: an apostrophe that begins a cut, with one or two letters behind it
        for i in np.flatnonzero((c == 39) & start & ~tail).tolist():
            two = "".join(map(chr, c[i + 1 : i + 3]))
            m = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if m and not head[i + 1 : i + 1 + m].any():
                start[i + 1] = False
                if m == 2:
                    start[i + 2] = False
                if i + 1 + m < n:
                    start[i + 1 + m] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [self.known and not any(s in t for s in self.special) for t in texts]
        joined = "".join(t for t, p in zip(texts, plain, strict=True) if p)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t, p in zip(texts, plain, strict=True) if p], np.int64)
        ends = np.cumsum(sizes)
        odd = np.zeros(len(sizes), bool)
        if len(c) and int(c.max()) >= PLAIN:
            odd[np.searchsorted(ends, np.flatnonzero(c >= PLAIN), side="right")] = True
        got: list[np.ndarray] = []
        if len(c):
            cuts = self._cuts(c, (ends - sizes)[sizes > 0])
            got = self._ids(joined, c, cuts, ends)
        out, k = [], 0
        for t, p in zip(texts, plain, strict=True):
            if p and not odd[k]:
                out.append(got[k] if got else np.zeros(0, np.uint32))
            else:
                out.append(np.asarray(self.library.encode(t, add_special_tokens=False).ids, np.uint32))
            k += p
        return out

    def _ids(self, joined: str, c: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        size = np.diff(np.r_[cuts, len(c)])
        place = np.arange(len(c)) - np.repeat(cuts, size)
        weight = mix(np.arange(int(size.max()), dtype=_U)) | _U(1)
        with np.errstate(over="ignore"):
            h = np.add.reduceat((c.astype(_U) + _U(1)) * weight[place], cuts)
        h = mix(h ^ size.astype(_U))
        keys, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.at) + len(keys) > CACHE:
            self._clear()
        known, names = self.at, keys.tolist()
        new = [i for i, x in enumerate(names) if x not in known]
        if new:
            at = one[new]
            self._learn([names[i] for i in new], [joined[s : s + n] for s, n in zip(cuts[at].tolist(), size[at].tolist(), strict=True)])
        entry = np.fromiter((known[x] for x in names), np.int64, len(names))[inverse]
        n = self.size[entry]
        last = np.cumsum(n)
        total = int(last[-1])
        ids = self.flat[np.repeat(self.start[entry] - (last - n), n) + np.arange(total)]
        # how many ids each text has: its cuts lie between its ends
        upto = np.r_[0, last][np.searchsorted(cuts, ends, side="left")]
        return np.split(ids, upto[:-1]) if len(upto) > 1 else [ids]
