"""Hard negatives, source divergence and line dedup beside brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import divergence, linededup, negatives, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_source_divergence", "op13_line_dedup"])
def test_beside_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), c.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def brute_negatives(rows, positives=5, per=10):
    """``rows``: (id, label, vector) as whole numbers, ids distinct."""
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, la, va in rows:
        if a % 100:
            continue
        others = sorted(((-score(va, v), i, lab) for i, lab, v in rows if i != a))
        for p, pid, _ in [x for x in others if x[2] == la][:positives]:
            fits = [x for x in others if x[2] != la and 30 * -p <= 100 * -x[0] <= 90 * -p]
            out |= {(a, pid, k, i, -p, -s) for k, (s, i, _) in enumerate(fits[:per], 1)}
    return out


def test_negatives_edges(spark):
    rnd = random.Random(3)
    vec = lambda: [rnd.choice([0.25, -0.5, 1.0, 0.125]) for _ in range(6)]
    rows = [(i, vec(), rnd.randint(0, 2)) for i in range(0, 700, 5)]
    rows += [(1001 + i, rows[3][1], i % 3) for i in range(30)]  # ties of one vector
    rows += [(2000, [1.0, 1.0], 1), (2100, [], 1), (2200, [-1.0] * 6, 2), (2300, [0.1] * 8, 0)]
    odd = [(None, vec(), 1), (3, None, 1), (4, [None, 1.0], 1), (6, [float("nan"), 1.0], 2), (8, [float("inf")], 2), (9, [1e30, 0.0], 2), (300, [9.0] * 6, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd + rows[:9]] + [(5, [9.0] * 6, 9, "y")], "vec_id bigint, embedding array<float>, label int, Rank string")
    want = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows]
    want = brute_negatives(want)
    assert len(want) > 200
    assert {tuple(r) for r in negatives.digest(df).collect()} == want
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    made = negatives.vectors(df, "vec_id", "embedding", shifted, 256)
    got = negatives.mine(made, F.col("id") % 100 == 0, tree=3, block=20)  # many trees and blocks
    assert {tuple(r) for r in got.collect()} == want
    assert negatives.digest(df.limit(0)).count() == 0 and negatives.digest(df.where("vec_id = 5")).count() == 0


def _walk_tables(vectors, labels, anchors):
    table = lambda at: pa.table({"id": pa.array(at, pa.int64()), "label": pa.array([labels[i] for i in at], pa.int64()), "v": pa.array([vectors[i].tolist() for i in at], pa.list_(pa.int32())), "tree": pa.array([0] * len(at), pa.int32())})
    return table(range(len(vectors))), negatives._spanning(table(anchors))


def test_tree_bounds_save_scores():
    """Where anchors lie close together the bounds leave most candidates alone; results stay exact."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (20, 16))
    vectors = np.concatenate([c + rng.integers(-3, 4, (100, 16)) for c in centres])
    labels = np.repeat(np.arange(20) % 4, 100).tolist()
    anchors = list(range(0, 2000, 10))
    block, tree = _walk_tables(vectors, labels, anchors)
    got, scored = negatives.nearest_of_label(block, tree, 5)
    assert scored < 0.2 * len(vectors) * len(anchors)
    exact = vectors @ vectors.T
    for a in anchors:
        order = sorted((-exact[a, i], i) for i in range(2000) if i != a and labels[i] == labels[a])[:5]
        found = [(r["positive_score"], r["positive_id"]) for r in got.filter(pa.compute.equal(got["anchor_id"], a)).to_pylist()]
        assert sorted(found) == sorted((-s, i) for s, i in order)


def test_scores_beyond_floats_stay_exact():
    vectors = np.array([[2**23 + 1] * 300, [2**23] * 300, [2**23 - 1] * 300, [1] * 300])
    block, tree = _walk_tables(vectors, [1, 1, 1, 1], [0, 1])
    got, _ = negatives.nearest_of_label(block, tree, 3)
    rows = {(r["anchor_id"], r["positive_id"]): r["positive_score"] for r in got.to_pylist()}
    assert rows[0, 1] == 300 * (2**23 + 1) * 2**23 and rows[1, 2] == 300 * 2**23 * (2**23 - 1)


def brute_audit(rows, min_docs, top):
    """``rows``: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, t in rows:
        groups[lang].add(source)
        counts[lang, source].update(words(t))
        held[lang].update(set(words(t)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        all_n = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(all_n)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms, 1)}
    return out


def test_audit_edges(spark, edge, edge_rows, empty):
    rnd = random.Random(2)
    vocabulary = ["the", "The", "thé", "été", "x1y", "日本", "ß", "I'm", *(f"w{a}{b}" for a in "abcdef" for b in "ghij")]
    rows = [(rnd.choice(["en", "fr", None, ""]), rnd.choice(["s1", "s2", "Ж", None, "s3"]), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for _ in range(300)]
    rows += [("en", "none", None), ("en", "none2", ""), ("alone", "one", "a b c"), ("rare", "r1", "q"), ("rare", "r2", "q"), *[("en", "s1", "hot " * 5000)] * 40]
    df = spark.createDataFrame([(*r, i, "c") for i, r in enumerate(rows)], "lang string, source string, text string, Part int, term string")
    want = brute_audit(rows, 10, 10)
    assert {r[0:2] for r in want if r[2] == "pair" and r[4] == 0} >= {("rare", "r1"), ("rare", "r2")}
    for bounds in ({}, {"postings": 20, "cells": 9}):
        got = [tuple(r) for r in divergence.audit(df, **bounds).collect()]
        assert len(got) == len(want) and set(got) == want
    few = divergence.audit(edge, min_docs=2, top=3)
    assert {tuple(r) for r in few.collect()} == brute_audit([(lang, s, t) for _, t, lang, s, _ in edge_rows], 2, 3)
    assert divergence.digest(empty).count() == 0


def test_audit_reads_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    t = ("ab cd " * 40 + "x" * 200 + " é").encode()
    pieces = list(divergence._pieces(t))
    assert len(pieces) > 3 and b"".join(pieces) == t and sum((divergence._TERM.findall(p) for p in pieces), []) == divergence._TERM.findall(t)


def brute_lines(rows, min_chars=40, min_docs=5):
    """``rows``: (id, text)."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(i)
    last = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(ids) >= min_docs and any(i is not None for i in ids)}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_edges(spark, edge_rows, empty):
    rnd = random.Random(4)
    shared = [f"Line {k} that very many documents share, said in Full" + "!" * k for k in range(40)] + ["é" * 40, "é" * 39, "x" * 39 + "Z", "-" * 20]
    rows = [(i, t) for i, t, *_ in edge_rows]
    for i in range(100, 180):
        lines = [rnd.choice(["  ", "\t", "", "\r"]) + (x.upper() if rnd.random() < 0.2 and x[0] != "é" else x) + rnd.choice(["", " \r", "\x0b"]) for x in rnd.sample(shared, 9)]
        rows.append((i, "\n".join([*lines, lines[0], f"own line of document {i}, which no other has at all"])))
    rows += [rows[-1], rows[-2], (None, rows[-3][1]), *[(None, "a line that only rows without any id hold at all")] * 6, (500, "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, N_Lines int, hi int")
    want = brute_lines(rows)
    assert sum(r[2] for r in want) > 300
    for bounds in ({}, {"broadcast_bytes": 0, "shard": 7}, {"broadcast_bytes": 21 * 30, "shard": 4}):
        out = linededup.dedup(df, **bounds)
        assert out.columns == ["doc_id", "text", "N_Lines", "hi", "n_lines_", "n_dropped"]
        got = sorted(((r[0], r[4], r[5], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in out.collect()), key=repr)
        assert got == want, bounds
    assert sorted((tuple(r) for r in linededup.digest(df).collect()), key=repr) == want
    assert linededup.digest(empty).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 30_000):
        hi, lo = rng.integers(0, 2**63, (2, n), dtype=np.int64).view(np.uint64)
        hi[: n // 4] = 5  # equal first halves part by the second
        shard = linededup.Shard.of(linededup.Shard(hi, lo, np.arange(n), np.arange(n) * 2).row())
        assert sorted(shard.slots(hi, lo)) == list(range(n))
        found, count, last = shard.probe(hi, lo)
        assert found.all() and (count == np.arange(n)).all() and (last == 2 * count).all()
        strangers = rng.integers(0, 2**63, (2, 500), dtype=np.int64).view(np.uint64)
        assert not shard.probe(*strangers)[0].any()
        assert len(shard.bits) * 8 < 64 * 20 + 8 * n
    with pytest.raises(ValueError):
        linededup.Shard(np.ones(2, np.uint64), np.ones(2, np.uint64), np.ones(2), np.ones(2))
