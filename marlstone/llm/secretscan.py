"""Secret scan: fixed patterns, then zstandard novelty of candidate strings in sensitive contexts.

A candidate is a long unbroken string behind a sensitive word. Its marginal cost is the compressed size of its
surroundings with the candidate less the size without it, both under a dictionary of the surroundings and of
identifiers. These are learned first: the words that identifiers are made of are counted over all texts that have a
sensitive context, and the ``DICTIONARY_WORDS`` most frequent join a few fixed ones. Only short runs of letters are
words, so a key that many copies of a text repeat does not get in. Copies of the candidate itself are taken out of its
surroundings, so a key that stands there twice is still news. A name or path that the code around it explains costs little,
a random key costs nearly its entropy. Candidates that cost ``min_ratio`` bytes for each of their characters, or nearly
what random strings of their length and alphabet cost there, are reported as kind ``novel``.

Zstandard codes a word of three or four letters in as many bytes, dictionary or not, so it cannot tell names made of
short words from keys; candidates must therefore also be no likelier, letter by letter, than a random draw. Of what
passes that, compression decides: strings put together from pieces that the code around them has (build names, paths of
hashes, ids of ids) look random by their letters, and are explained by the surroundings alone.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; spans are code points of
the whole text, end exclusive; an empty table gives an empty result; other columns pass through ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import textkit
from marlstone.llm.columns import others
from marlstone.session import ship

#: The kinds in the order that breaks ties of their starts.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as runs of [0-9a-f]+ of that length

#: Words that make what follows them sensitive, and identifiers that are no news.
CONTEXT = re.compile(
    r"(?:auth|bearer|credential|private|pwd|passphrase|signature|session|cookie|access|key|pass(?:word|wd)?|secret|token|salt|licen[cs]e)[A-Za-z_]{0,12}"
    r"""["']?[\x20\t]*(?:[:=]|=>|\x20is\x20)?[\x20\t]*["']?([A-Za-z0-9+/_=-]{12,})""",
    re.ASCII | re.IGNORECASE,
)
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization bearer basic credentials username user_name login session_id cookie signature certificate "
    "get_token set_password generate_key create_session request response headers content_type application_json "
    "config settings environment production development staging default example placeholder changeme localhost "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"
).encode()

#: Words that the dictionary of identifiers learns at most (some 20 kB): the bound of what goes through the driver.
DICTIONARY_WORDS = 2000
#: The same contexts for the JVM, and the words that identifiers are made of: cut at case changes and other signs.
HINT = r"(?i)(?:auth|bearer|credential|private|pwd|passphrase|signature|session|cookie|access|key|pass(?:word|wd)?|secret|token|salt|licen[cs]e)"
WORD = r"(?<![A-Za-z])[A-Z]?[a-z]{3,15}(?![a-z])|(?<=[a-z])[A-Z][a-z]{3,15}(?![a-z])|(?<![A-Za-z])[A-Z]{4,15}(?![A-Za-z])"
_WORDS = re.compile(WORD)

REACH = 1024
MIN_RATIO = 0.75
#: Share of the least cost of so many random strings that makes a candidate novel, whatever its alphabet.
OF_RANDOM, DRAWS = 0.9, 3
_DIGITS, _LOW = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOW, _LOW.upper(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=", _LOW + _LOW.upper())
ALPHABETS += (_LOW + _DIGITS, _LOW.upper() + _DIGITS, _LOW + _LOW.upper() + _DIGITS, _LOW + _LOW.upper() + _DIGITS + "+/_=-")
#: What joins the words of an identifier counts as a space.
_JOINTS = str.maketrans("_-/", "   ")
_SETS = [frozenset(x) for x in ALPHABETS]


def learn(docs: DataFrame, text: str = "text", most: int = DICTIONARY_WORDS) -> bytes:
    """The most frequent words of identifiers in all texts that have a sensitive context; the commonest come last."""
    near = docs.where(F.col(text).rlike(HINT + r"[A-Za-z_]{0,12}[\"']?[ \t]*(?:[:=]|=>| is )?[ \t]*[\"']?[A-Za-z0-9+/_=-]{12}"))
    words = near.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("w"))
    top = words.groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(most).collect()
    return " ".join(r.w for r in reversed(top)).encode()


class _Around:
    """The surroundings of text[start:end], without any copy of it: a key that stands there twice excuses itself nowhere."""

    def __init__(self, text: str, start: int, end: int, reach: int, learned: bytes):
        self.own = text[start:end]
        self.left = text[max(0, start - reach) : start].replace(self.own, " ")
        self.right = text[end : end + reach].replace(self.own, " ")
        self.learned = learned
        self._coder = None

    def cost(self, *strings: bytes) -> list[int]:
        """Bytes that each string adds to the compressed surroundings in the candidate's place."""
        left = self.left.encode()
        near = left[-64:]
        if self._coder is None:
            data = IDENTIFIERS + self.learned + left + self.right.encode()
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._coder = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False)
            self._base = len(self._coder.compress(near))
        return [len(self._coder.compress(near + x)) - self._base for x in strings]

    def unlikely(self) -> bool:
        """Letter pairs of identifiers and of the words around explain the candidate no better than a draw from its alphabet."""
        known_pairs, known_one, size = _letters(IDENTIFIERS + b" " + self.learned + b" ")
        around = " ".join(_WORDS.findall(self.left + " " + self.right)).lower()
        pairs, one = Counter(zip(around, around[1:], strict=False)), Counter(around)
        size += len(around)
        cost, before = 0.0, " "
        for c in self.own.lower().translate(_JOINTS):
            single = (one[c] + known_one[c] + 0.5) / (size + 48)
            cost -= math.log2((pairs[before, c] + known_pairs[before, c] + 4 * single) / (one[before] + known_one[before] + 4))
            before = c
        return cost >= len(self.own) * math.log2(len(set(_alphabet(self.own).lower())))


def marginal_ratio(text: str, start: int, end: int, reach: int = REACH, learned: bytes = b"") -> float:
    """Bytes that text[start:end] adds to its compressed surroundings, for each of its own bytes."""
    own = text[start:end].encode()
    return _Around(text, start, end, reach, learned).cost(own)[0] / max(1, len(own))


def _alphabet(own: str) -> str:
    """The smallest of the alphabets that hold all of a string."""
    return ALPHABETS[next((k for k, x in enumerate(_SETS) if x.issuperset(own)), -1)]


def _random(alphabet: str, n: int, k: int) -> bytes:
    """The k-th of the fixed random strings."""
    return "".join(alphabet[x % len(alphabet)] for x in memoryview(hashlib.shake_128(f"{alphabet}:{n}:{k}".encode()).digest(4 * n)).cast("I")).encode()


#: Short random strings are drawn once: 4,000 of 256 bytes, a megabyte at most.
_short = lru_cache(4_000)(_random)


def _draws(own: str) -> list[bytes]:
    """Random strings of a candidate's alphabet and length."""
    draw = _short if len(own) <= 256 else _random
    return [draw(_alphabet(own), len(own), k) for k in range(DRAWS)]


@lru_cache(4)
def _letters(data: bytes) -> tuple[Counter, Counter, int]:
    """Letter pairs, letters and size of a dictionary."""
    t = data.decode().lower().translate(_JOINTS)
    return Counter(zip(t, t[1:], strict=False)), Counter(t), len(t)


def novel(text: str, start: int, end: int, min_ratio: float = MIN_RATIO, reach: int = REACH, learned: bytes = b"") -> bool:
    """text[start:end] is news to its surroundings."""
    around = _Around(text, start, end, reach, learned)
    if not around.unlikely():
        return False
    cost = around.cost(around.own.encode())[0]
    if cost >= min_ratio * len(around.own):
        return True
    return cost >= OF_RANDOM * min(around.cost(*_draws(around.own)))


def spans(text: str | None, min_ratio: float = MIN_RATIO, learned: bytes = b"") -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span of a text, sorted."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken: list[list[int]] = []
    for s, _, e in sorted(found):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    i = 0
    for m in CONTEXT.finditer(text):
        s, e = m.span(1)
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i < len(taken) and taken[i][0] < e:
            continue
        if novel(text, s, e, min_ratio, learned=learned):
            found.append((s, 3, e))
    return sorted(found)


def _told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, text: str = "text", min_ratio: float = MIN_RATIO, learned: bytes | None = None) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end) for each text, as it is read, without a shuffle.

    ``learned``: what ``learn`` has returned; by default it is learned from ``docs``.
    """
    ship(docs.sparkSession)
    learned = learn(docs, text) if learned is None else learned
    kept = others(docs, "secrets")
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    one = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    schema = T.StructType(list(docs.schema.fields)).add("secrets", T.ArrayType(one))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch, text):
                b = batch.slice(i, j - i)
                made = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t.as_py(), min_ratio, learned)] for t in b.column(text)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], [*b.schema.names, "secrets"])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the number of novel spans."""
    s = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    told = lambda a: F.array_join(
        F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    return s.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told(F.filter("secrets", lambda x: x["kind"] != "novel")), 256).alias("base_sha256"),
        told(F.col("secrets")).alias("spans"),
        count("novel").alias("n_novel"),
    )


def mask(docs: DataFrame, text: str = "text", by: str = "*") -> DataFrame:
    """``docs`` with every character of every span replaced by ``by``."""
    s = scan(docs, text)
    cut = F.aggregate(
        "secrets",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(
            F.struct(
                F.concat(
                    a["done"],
                    F.substring(F.col(text), (a["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - a["at"]).cast("int")),
                    F.repeat(F.lit(by), (x["end"] - F.greatest(x["start"], a["at"])).cast("int")),
                ).alias("done"),
                x["end"].alias("at"),
            )
        ),
        lambda a: F.concat(a["done"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(F.col(text)))),
    )
    return s.select(*((F.when(F.size("secrets") > 0, cut).otherwise(F.col(text)).alias(text)) if c == text else F.col(f"`{c}`") for c in docs.columns))
