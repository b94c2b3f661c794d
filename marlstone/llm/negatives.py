"""Hard-negative mining: spanning trees of anchors bound the scores of candidates.

Scores are inner products of integer vectors. Anchors are dealt to trees of bounded size, near ones together; each tree is
a minimum spanning tree over its anchors. A block of candidates walks down a tree: if a parent anchor's score of a
candidate lies in [lo, hi], its child's lies in [lo - d n, hi + d n], where d is the length of the edge and n the
candidate's norm (Cauchy-Schwarz). Only candidates whose interval overlaps a window that still counts are scored again.
Each pair of a tree and a block is one group of bounded size, so a walk is spread over trees x blocks tasks; what a group
keeps is its best rows of each window, and these are merged.

The first walk finds the best rows of an anchor's own label (its positives), the second the best rows of other labels in
the window that each positive opens.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do those
with a scaled component of 2^24 or more in size, whose scores could leave 64 bits. Rows that share an id count once, as
the one with the smallest label, then the smallest vector. Vectors of different lengths are compared as if the shorter
ended in zeros; an empty vector has score 0 with all. Ties go to the smaller id. No anchors or no rows give an empty
result; extra columns are left behind.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import cut
from marlstone.session import ship

#: Anchors of a tree, and candidates of a block, at most about.
TREE, BLOCK = 1024, 8192
#: Components of this size or more cannot be scored in 64 bits.
LARGEST = 1 << 24
_ROOM = 1 + 1e-9


def vectors(rows: DataFrame, id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v): floor(scale * component) of every row that takes part, one row for each id."""
    x = F.transform(F.col(vector), lambda e: F.lit(float(scale)) * e.cast("double"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST))
    out = rows.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("v"))
    out = out.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(fine)
    out = out.select("id", "label", F.transform("v", lambda e: F.floor(e).cast("int")).alias("v"))
    return out.groupBy("id").agg(F.min(F.struct("label", "v")).alias("b")).select("id", "b.label", "b.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, filled up with zeros."""
    a = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(np.asarray(a.offsets))
    out = np.zeros((len(a), width), np.float64)
    out[np.repeat(np.arange(len(a)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(a.flatten())
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max([1, *(len(x) for c in columns for x in c if x.is_valid)])


def _ids(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64)


_NODE = "tree int, place int, parent int, edge double, id bigint, label bigint, v array<int>"


def _spanning(t: pa.Table) -> pa.Table:
    """A minimum spanning tree over the anchors of a table (Prim); parents come before their children."""
    t = t.sort_by("id")
    m, n = _matrix(t.column("v"), _width(t.column("v"))), t.num_rows
    near, by, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    order, at = [], 0
    for _ in range(n):
        order.append(at)
        done[at] = True
        d = ((m - m[at]) ** 2).sum(1)
        closer = ~done & (d < near)
        near[closer], by[closer] = d[closer], at
        at = int(np.argmin(np.where(done, np.inf, near)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    parent = np.where(by < 0, -1, place[by])
    edge = np.sqrt(np.where(by < 0, 0.0, near)) * _ROOM
    cols = {"tree": t.column("tree"), "place": pa.array(place, pa.int32()), "parent": pa.array(parent, pa.int32()), "edge": pa.array(edge), "id": t.column("id"), "label": t.column("label"), "v": t.column("v")}
    return pa.table(cols)


def trees(anchors: DataFrame, size: int = TREE) -> DataFrame:
    """The anchors with their tree, their place in it, and the place and the distance of their parent."""
    n = math.ceil(anchors.count() / size)
    if n > 1:  # near anchors share signs of fixed projections, and so a range
        side = lambda j: F.aggregate(F.transform("v", lambda x, i: x * (1 - 2 * F.pmod(F.xxhash64(i, F.lit(j)), F.lit(2)))), F.lit(0).cast("bigint"), lambda a, x: a + x) > 0
        sign = F.concat(*(F.when(side(j), "1").otherwise("0") for j in range(16)))
        anchors = anchors.withColumn("sign", sign).repartitionByRange(n, "sign", "id").withColumn("tree", F.spark_partition_id()).drop("sign")
    else:
        anchors = anchors.withColumn("tree", F.lit(0))
    return anchors.groupBy("tree").applyInArrow(_spanning, _NODE)


class _Walk:
    """A block of candidates on its way down a tree; ``scored`` counts the scores that were computed."""

    def __init__(self, block: pa.Table, tree: pa.Table):
        tree = tree.sort_by("place")
        width = _width(block.column("v"), tree.column("v"))
        self.m, self.a = _matrix(block.column("v"), width), _matrix(tree.column("v"), width)
        self.ids, self.labels = _ids(block, "id"), _ids(block, "label")
        self.anchors, self.of = _ids(tree, "id"), _ids(tree, "label")
        self.parent, self.edge = _ids(tree, "parent"), tree.column("edge").to_numpy()
        self.norm = np.sqrt((self.m**2).sum(1)) * _ROOM
        top = float(self.norm.max(initial=0)) * float(np.sqrt((self.a**2).sum(1)).max(initial=0))
        self.exact = top < 2**52  # whole numbers in floats up to here
        if not self.exact:
            self.m, self.a = self.m.astype(np.int64), self.a.astype(np.int64)
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=len(self.anchors))
        self.scored = 0

    def _score(self, i: int, rows: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        got = (self.m if len(rows) == len(self.m) else self.m[rows]) @ self.a[i]
        return np.rint(got).astype(np.int64) if self.exact else got

    def run(self, choose, take) -> None:
        """``choose(i, lo, hi)`` names the candidates to score at anchor i, ``take(i, rows, scores)`` gets the scores."""
        kept: dict[int, list] = {}
        for i in range(len(self.anchors)):
            p = int(self.parent[i])
            if p < 0:
                lo, hi = np.full(len(self.m), -np.inf), np.full(len(self.m), np.inf)
                rows = np.arange(len(self.m))
            else:
                room = self.edge[i] * self.norm
                lo, hi = kept[p][0] - room, kept[p][1] + room
                rows = choose(i, lo, hi)
            s = self._score(i, rows)
            # scores beyond 2^52 are rounded as floats: the interval is opened by as much
            slack = 0.0 if self.exact else np.abs(s) * 1e-12
            lo[rows], hi[rows] = s - slack, s + slack
            if self.children[i]:
                kept[i] = [lo, hi, self.children[i]]
            if p >= 0:
                kept[p][2] -= 1
                if not kept[p][2]:
                    del kept[p]
            take(i, rows, s)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= floor)
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _kth(x: np.ndarray, k: int) -> float:
    """The k-th largest; below all if there are fewer."""
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


_POSITIVE = "anchor_id bigint, positive_id bigint, positive_score bigint"
_NEGATIVE = _POSITIVE + ", negative_id bigint, negative_score bigint"


def _table(columns: dict[str, list]) -> pa.Table:
    return pa.table({k: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for k, x in columns.items()})


def nearest_of_label(block: pa.Table, tree: pa.Table, k: int) -> tuple[pa.Table, int]:
    """The block's k best rows of each anchor's own label, without itself; and how many scores that took."""
    out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": []}
    if not block.num_rows or not tree.num_rows:
        return _table(out), 0
    w = _Walk(block, tree)
    own = lambda i: np.flatnonzero((w.labels == w.of[i]) & (w.ids != w.anchors[i]))

    def choose(i: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        rows = own(i)
        return rows[hi[rows] >= _kth(lo[rows], k)]

    def take(i: int, rows: np.ndarray, s: np.ndarray) -> None:
        if w.parent[i] < 0:
            s = s[rows := own(i)]
        b = _best(w.ids[rows], s, k)
        out["anchor_id"].append(np.full(len(b), w.anchors[i]))
        out["positive_id"].append(w.ids[rows[b]])
        out["positive_score"].append(s[b])

    w.run(choose, take)
    return _table(out), w.scored


def negatives_in_windows(block: pa.Table, tree: pa.Table, k: int, low: int, high: int) -> tuple[pa.Table, int]:
    """The block's k best rows of other labels in the window of each positive; and how many scores that took."""
    out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": [], "negative_id": [], "negative_score": []}
    if not block.num_rows or not tree.num_rows:
        return _table(out), 0
    w = _Walk(block, tree)
    # low * p <= 100 * n <= high * p, in whole numbers
    windows = [[(x["id"], x["score"], -((-low * x["score"]) // 100), high * x["score"] // 100) for x in p or []] for p in tree.sort_by("place").column("positives").to_pylist()]

    def choose(i: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero(w.labels != w.of[i]) if windows[i] else np.zeros(0, np.int64)
        lo, hi, need = lo[rows], hi[rows], np.zeros(len(rows), bool)
        for _, _, least, most in windows[i]:
            if least <= most:
                sure = lo[(lo >= least) & (hi <= most)]
                need |= (hi >= max(least, _kth(sure, k))) & (lo <= most)
        return rows[need]

    def take(i: int, rows: np.ndarray, s: np.ndarray) -> None:
        other = w.labels[rows] != w.of[i]
        rows, s = rows[other], s[other]
        for positive, score, least, most in windows[i]:
            at = np.flatnonzero((s >= least) & (s <= most))
            b = at[_best(w.ids[rows[at]], s[at], k)]
            for name, x in (("anchor_id", w.anchors[i]), ("positive_id", positive), ("positive_score", score)):
                out[name].append(np.full(len(b), x))
            out["negative_id"].append(w.ids[rows[b]])
            out["negative_score"].append(s[b])

    w.run(choose, take)
    return _table(out), w.scored


def _met(rows: DataFrame, nodes: DataFrame, n_trees: int, n_blocks: int, work, schema: str) -> DataFrame:
    """``work`` on every pair of a block of rows and a tree, each pair a group."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("tree", each(n_trees)).groupBy("tree", "block")
    right = nodes.withColumn("block", each(n_blocks)).groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(work, schema)


def _first(df: DataFrame, by: list[str], score: str, id: str, k: int) -> DataFrame:
    """The k best rows of each group, ranked; Spark keeps only k of a group before the shuffle, too."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(id))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, per: int = 10, low: int = 30, high: int = 90, tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors``.

    Anchors are the rows for which ``anchor`` holds. ``positives`` best rows of its label each open a window of ``low``
    to ``high`` percent of their score; the ``per`` best rows of other labels in it are returned.
    """
    ship(rows.sparkSession)
    rows = cut(rows)
    n_blocks = max(1, math.ceil(rows.count() / block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    nodes = cut(trees(rows.where(anchor), tree))
    n_trees = nodes.agg(F.coalesce(F.max("tree") + 1, F.lit(1))).first()[0]
    found = _met(dealt, nodes, n_trees, n_blocks, lambda b, t: nearest_of_label(b, t, positives)[0], _POSITIVE)
    best = _first(found, ["anchor_id"], "positive_score", "positive_id", positives)
    best = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    nodes = cut(nodes.join(best, "id", "left"))
    hard = _met(dealt, nodes, n_trees, n_blocks, lambda b, t: negatives_in_windows(b, t, per, low, high)[0], _NEGATIVE)
    out = _first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", per)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: labels shifted where the id is divisible by 7, anchors where it is divisible by 100."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return mine(vectors(embeddings, "vec_id", "embedding", shifted, 256), F.col("id") % 100 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INT AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
