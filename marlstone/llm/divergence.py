"""Source divergence audit: how far the sources of a language lie apart, and which terms set a source off.

Texts are counted once, within their tasks first. Kept terms form an index that is dealt by term; the triangular
discrimination f of every two sources is a sum over terms, so each part of the index gives a share of it. Within a part
the rows of the product are built one by one (Gustavson): a source scatters its terms through the postings of the part
into a dense accumulator over its peers, and no pair of postings is ever emitted. Zero counts have a share of their own,
so an accumulator starts from the baseline of two absent terms; terms that only one side has are corrected by how often
each share occurs, and the scattered postings correct what both have:

    sum f(p, q) = V f(p0, q0) + sum over p's terms [f(p, q0) - f(p0, q0)] + sum over q's terms [f(p0, q) - f(p0, q0)]
                + sum over both's terms [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

All numbers are whole. Defined results: null text, lang and source are ''; every row is a document, so repeated rows count
as often as they come; a source without terms has its pairs; a language without kept terms has pairs of value 0 and no
terms; a language's only source has no pairs; an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.columns import LOWER, UPPER, whole
from marlstone.llm.store import cut
from marlstone.session import ship

MIN_DOCS, TOP = 10, 10
#: Postings of a part of the index, and cells of its accumulators, about.
POSTINGS, CELLS = 500_000, 1 << 20
#: Counters of a task are emitted at so many terms; a text is read in pieces of so many bytes.
HELD, PIECE = 300_000, 4 << 20
#: Up to so many sources, and bytes of their names, go to the postings by broadcast.
BROADCAST_SOURCES, BROADCAST_BYTES = 50_000, 8 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between terms."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term of each source, summed within the task; term '' tells that a source occurs."""
    n: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in n.items():
            names = list(terms)
            own = docs[lang, source]
            columns = [[lang] * len(names), [source] * len(names), [x.decode() for x in names], [terms[x] for x in names], [own[x] for x in names]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        for lang, source, t in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text, strict=True):
            counts, seen = n[lang, source], set()
            counts.setdefault(b"", 0)
            for piece in _pieces(t.as_py().lower()):
                found = _TERM.findall(piece)
                counts.update(found)
                seen.update(found)
            docs[lang, source].update(seen)
            if sum(map(len, n.values())) > HELD:
                yield from out()
    yield from out()


def _share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + 2) / total), in decimals, so that no count is too large."""
    return F.expr(f"1 + cast({count} + 2 as decimal(20, 0)) * cast(1000000000 as decimal(10, 0)) div {total}")


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, all_n, first): kept terms of each source, and one row of term '' for each source.

    ``all_n`` counts the term in the language; ``first`` marks one row of each term.
    """
    ship(docs.sparkSession)
    rows = docs.select(*(whole(F.col(c).cast("string")).alias(c) for c in ("lang", "source", "text")))
    # dealt by (lang, term) once: sources, languages and totals are all summed on that
    c = rows.mapInArrow(_counted, _COUNTED).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    c = c.select("lang", "source", "term", "n", F.sum("n").over(w).alias("all_n"), F.sum("docs").over(w).alias("all_docs"), (F.min("source").over(w) == F.col("source")).alias("first"))
    return c.where((F.col("term") == "") | (F.col("all_docs") >= min_docs)).drop("all_docs")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def scatter(index: pa.Table, sources: pa.Table) -> pa.Table:
    """The share of one part of the index in every pair of a source of ``mine`` and a peer.

    ``index``: source, term, p. ``sources``: source, p0 (null if the language keeps no term), mine; all of a language.
    """
    names = sources.column("source").to_pylist()
    size = len(names)
    place = {x: i for i, x in enumerate(names)}
    p0 = np.asarray(sources.column("p0").to_numpy(zero_copy_only=False), float)
    p0 = np.where(np.isnan(p0), 1, p0).astype(np.int64)
    coded = index.column("source").combine_chunks().dictionary_encode()
    of = np.array([place[x] for x in coded.dictionary.to_pylist()] or [0], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    terms = index.column("term").combine_chunks().dictionary_encode()
    term, n_terms, p = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary), index.column("p").to_numpy().astype(np.int64)
    by_term = np.argsort(term, kind="stable")
    peers, theirs = of[by_term], p[by_term]
    ends = np.cumsum(np.bincount(term, minlength=n_terms)) if n_terms else np.zeros(0, np.int64)
    starts = ends - np.bincount(term, minlength=n_terms) if n_terms else ends
    # how often a peer has each share: its terms enter the baseline by these
    pairs, often = np.unique(np.stack([of, p]), axis=1, return_counts=True)
    by_source = np.argsort(of, kind="stable")
    first = np.searchsorted(of[by_source], np.arange(size + 1))
    total = lambda at, x: np.rint(np.bincount(at, x, size)).astype(np.int64)  # noqa: E731  sums stay below 2^53
    mine, rows = np.flatnonzero(sources.column("mine").to_numpy(zero_copy_only=False)), []
    for g in mine:
        own = by_source[first[g] : first[g + 1]]
        zero = _f(p0[g], p0)
        acc = (n_terms - len(own)) * zero
        shares, times = np.unique(p[own], return_counts=True)
        for a in range(0, len(shares), step := max(1, CELLS // max(1, size))):
            acc = acc + (_f(shares[a : a + step, None], p0[None]) * times[a : a + step, None]).sum(0)
        acc = acc + total(pairs[0], (_f(p0[g], pairs[1]) - zero[pairs[0]]) * often)
        lengths = (ends - starts)[term[own]]
        for piece in np.array_split(np.arange(len(own)), math.ceil(lengths.sum() / CELLS) or 1):
            n = lengths[piece]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term[own[piece]]], n)
            mine_p, o, q = np.repeat(p[own[piece]], n), peers[at], theirs[at]
            acc = acc + total(o, _f(mine_p, q) - _f(mine_p, p0[o]) - _f(p0[g], q) + zero[o])
        rows.append(acc)
    acc = np.array(rows, np.int64).reshape(len(mine), size)
    g, o = np.repeat(mine, size), np.tile(np.arange(size), len(mine))
    other = g != o
    all_names = pa.array(names, pa.string())
    lang = sources.column("lang").combine_chunks().take(pa.array(g[other]))
    return pa.table({"lang": lang, "source": all_names.take(pa.array(g[other])), "item": all_names.take(pa.array(o[other])), "value": acc.ravel()[other]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, postings: int = POSTINGS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): every source's peers by distance, and its ``top`` terms above the language's share.

    Needs lang, source and text. ``postings`` and ``cells`` bound a part of the index and its accumulators.
    """
    kept = cut(term_counts(docs, min_docs))
    real = F.col("term") != ""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum((real & F.col("first")).cast("bigint")).alias("v"), F.sum(real.cast("bigint")).alias("nnz"))
    w = Window.partitionBy("lang")
    sources = sums.select("lang", "source", "nnz", (F.col("n") + 2 * F.sum("v").over(w)).alias("d"), (F.sum("n").over(w) + 2 * F.sum("v").over(w)).alias("all_d"), F.count("*").over(w).alias("peers"))
    sources = cut(sources.withColumns({"d": F.nullif("d", F.lit(0)), "all_d": F.nullif("all_d", F.lit(0))}).withColumn("p0", _share("0", "d")))
    size = sources.agg(F.count("*").alias("n"), F.sum(F.octet_length("lang") + F.octet_length("source")).alias("bytes"), F.sum("nnz").alias("nnz"), F.max("peers").alias("peers")).first()
    few = size["n"] <= BROADCAST_SOURCES and (size["bytes"] or 0) <= BROADCAST_BYTES
    known = sources.select("lang", "source", "d", "all_d")
    index = kept.where(real).join(F.broadcast(known) if few else known, ["lang", "source"]).withColumn("p", _share("n", "d"))
    rank = lambda part: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    above = index.withColumn("q", _share("all_n", "all_d")).where("n > 0 AND p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    above = above.select("*", rank("term")).where(F.col("rank") <= top)

    parts, bands = math.ceil((size["nnz"] or 0) / postings) or 1, math.ceil((size["peers"] or 0) ** 2 / cells) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    band = F.pmod(F.xxhash64("source"), F.lit(bands))
    left = index.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), each(bands).alias("band"))
    right = sources.select(*(F.col(c).alias(c) for c in ("lang", "source", "p0")), each(parts).alias("part"), band.alias("own")).select("*", each(bands).alias("band")).withColumn("mine", F.col("own") == F.col("band"))
    shares = left.groupBy("lang", "part", "band").cogroup(right.groupBy("lang", "part", "band")).applyInArrow(scatter, "lang string, source string, item string, value bigint")
    pairs = shares.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank("pair"))
    return pairs.unionByName(above)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return audit(docs)


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10
), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3
), dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM dense
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM dense GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term QUALIFY rank <= 10
"""
