"""Toxicity as significant maximum-scoring segments of token log-odds.

Learning: for each token, the log-odds of toxic against other labelled documents under a Dirichlet prior that follows
the pooled frequencies; tokens whose z-score is beyond ``z_min`` keep their log-odds, all others only carry the drift.
Scoring: one linear scan finds every maximal-scoring segment of a text (all of them, not just the best); a segment's
extreme-value statistics turn its score and the text's length into the expected number of such segments by chance,
and those below ``max_expected`` are its toxic passages. Their joint evidence is put on the scale of probabilities by
a logistic curve of one input, fitted to the training rows.

``fit`` uses at most about ``max_rows`` labelled rows (a sample by hash), so the model that is sent to the executors is
bounded by that parameter. Scores depend on texts alone.

Defined results: null and empty texts have no segments and the score of no evidence; labels that are null, or whose
text is missing, are not used; of repeated labels for a document the largest counts; without toxic or without other
training rows every score is 0; other columns pass through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import textkit
from marlstone.llm.columns import NOT_ALNUM, ascii_lower, others, whole, words
from marlstone.llm.store import cut
from marlstone.session import ship

MAX_ROWS = 20_000
PRIOR = 50.0
#: Every token has at least so much prior, so that one never seen in a class keeps a finite variance.
FLOOR = 0.5
Z_MIN = 2.8
MIN_DOCS = 4
DRIFT = 0.08
MAX_EXPECTED = 1.0

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


@dataclass
class Model:
    """What is sent to the executors: token hashes in order with their scores, and the calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = DRIFT
    rate: float = 1.0  # lambda of the extreme-value statistics
    scale: float = 1.0  # K
    max_expected: float = MAX_EXPECTED
    slope: float = 0.0
    shift: float = -50.0


def segments(places: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment as (first place, last place, score), in linear time.

    ``places`` and ``scores`` are the scored tokens in order; every token costs the drift besides. Candidates are kept
    on a list with the totals before and behind them; each step looks back along links, never at a candidate twice.
    """
    total, last = 0.0, -1
    found: list[list[float]] = []  # first, last, total before, total behind
    link: list[int] = []  # the nearest earlier candidate with a smaller total before it
    for p, s in zip(places.tolist(), scores.tolist(), strict=True):
        before = total - drift * (p - last - 1)
        total = behind = before + s - drift
        last = p
        if s <= drift:
            continue
        first = p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = link[j]
            if j < 0 or found[j][3] >= behind:
                found.append([first, p, before, behind])
                link.append(j)
                break
            first, before = int(found[j][0]), found[j][2]
            del found[j:], link[j:]
    return [(int(a), int(b), e - d) for a, b, d, e in found]


def evidence(n: int, parts: list[tuple[int, int, float]], m: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """The joint evidence of a text of ``n`` tokens, and its significant segments."""
    base = np.log(m.scale * max(n, 1))
    good = [x for x in parts if m.rate * x[2] - base >= -np.log(m.max_expected)]
    return float(sum(m.rate * x[2] for x in good) - base) if good else 0.0, good


def _scan(column: pa.Array, m: Model) -> Iterator[tuple[int, float, list[tuple[int, int, float]], list[tuple[int, int, float]]]]:
    """(tokens, evidence, significant segments, all segments) of each text."""
    b, offsets = textkit.buffer(column)
    starts, ends, at = textkit.words(b, offsets, _WORD)
    h = textkit.hashes(b, starts, ends)
    k = np.minimum(np.searchsorted(m.keys, h), max(0, len(m.keys) - 1))
    hit = np.flatnonzero(m.keys[k] == h) if len(m.keys) else np.zeros(0, np.int64)
    cut = np.searchsorted(hit, at)
    for i in range(len(column)):
        mine = hit[cut[i] : cut[i + 1]]
        n = int(at[i + 1] - at[i])
        parts = segments(mine - at[i], m.scores[k[mine]], m.drift) if len(mine) else []
        x, good = evidence(n, parts, m)
        yield n, x, good, parts


def tokens(text: Column) -> Column:
    return words(ascii_lower(whole(text)), NOT_ALNUM)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, prior: float = PRIOR, z_min: float = Z_MIN, drift: float = DRIFT) -> Model:
    """Learn a model from the labelled rows (columns doc_id, toxic) and their documents (doc_id, text)."""
    ship(docs.sparkSession)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    # known has about max_rows ids at most (some 300 kB), so the texts stay where they are; rows is kept for its three uses
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("toxic").alias("y"), "text")
    # copies of a text tell nothing new
    rows = cut(rows.dropDuplicates(["y", "text"]))
    each = rows.select("y", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    counts = each.groupBy("t").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("b")
    )
    totals = counts.agg(F.sum("a"), F.sum("b")).first()
    if not totals[0] or not totals[1]:
        return Model()
    na, nb = F.lit(float(totals[0])), F.lit(float(totals[1]))
    alpha = (F.col("a") + F.col("b")) / (na + nb) * prior + FLOOR
    odds = lambda x, total: F.log((x + alpha) / (total + prior - x))
    delta = odds(F.col("a"), na) - odds(F.col("b"), nb)
    z = delta / F.sqrt(1 / (F.col("a") + alpha) + 1 / (F.col("b") + alpha))
    kept = counts.select("t", "b", delta.alias("s"), z.alias("z")).where((F.abs("z") >= z_min) & (F.col("a") + F.col("b") >= MIN_DOCS))
    table = kept.orderBy("t").toPandas()  # bounded: tokens of at most about max_rows texts
    m = Model(drift=drift)
    if not len(table):
        return m
    data = pa.array(table["t"].tolist(), pa.string())
    b, offsets = textkit.buffer(data)
    keys = textkit.hashes(b, offsets[:-1], offsets[1:])
    order = np.argsort(keys)
    m.keys, m.scores = keys[order], table["s"].to_numpy(float)[order]
    # the rate at which chance segments thin out: E[exp(rate * score)] = 1 over tokens of other documents
    share = (table["b"].to_numpy(float)[order] + 0.5) / float(totals[1])
    gain = m.scores - drift
    low, high = 1e-3, 8.0
    mean = lambda r: float((share * np.exp(r * gain)).sum() + max(0.0, 1 - share.sum()) * np.exp(-r * drift))
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    m.rate = low

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch):
                part = batch.slice(i, j - i)
                got = [(n, max((p[2] for p in parts), default=0.0)) for n, _, _, parts in _scan(part.column("text"), m)]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], names=["y", "n", "top"])

    top = rows.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(best, "y int, n bigint, top double").toPandas()
    clean = top[top.y != 1]
    # maximum likelihood of K for the best segments of other documents
    m.scale = float(max(1e-6, len(clean) / max(1e-9, (clean.n.clip(lower=1) * np.exp(-m.rate * clean.top)).sum())))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch):
                part = batch.slice(i, j - i)
                got = [x for _, x, _, _ in _scan(part.column("text"), m)]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(got, pa.float64())], names=["y", "x"])

    seen = rows.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(weigh, "y int, x double").toPandas()
    m.slope, m.shift = _logistic(np.minimum(seen.x.to_numpy(float), 40.0), (seen.y == 1).to_numpy(float))
    return m


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps with a light ridge; the slope is not negative."""
    design = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - np.array([0.01, 0.0]) * w
        curve = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + np.diag([0.01, 1e-6])
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return max(0.0, float(w[0])), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``n_tokens`` and ``passages``: (first, last, score) of the significant segments,
    counted in tokens."""
    spark = ship(docs.sparkSession)
    own = ("score", "n_tokens", "passages")
    docs = docs.select(*(F.col(f"`{c}`") for c in others(docs, *own)))
    one = T.StructType().add("first", "long").add("last", "long").add("score", "double")
    schema = T.StructType(list(docs.schema.fields)).add("score", "double").add("n_tokens", "long").add("passages", T.ArrayType(one))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for i, j in textkit.slices(batch):
                part = batch.slice(i, j - i)
                got = list(_scan(part.column("text"), m))
                x = np.minimum(np.array([g[1] for g in got]), 40.0)
                p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.shift, -500, 500)))
                passages = [[{"first": a, "last": b, "score": s} for a, b, s in g[2]] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p, pa.float64()), pa.array([g[0] for g in got], pa.int64()), pa.array(passages, kind)],
                    names=[*part.schema.names, *own],
                )

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the number of toxic passages. Held-out rows never reach ``fit``."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    s = score(docs.select("doc_id", "text"), model)
    return s.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
