"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Test items become windows of ``width`` words (a shorter item is one window). Every token window of every document
is hashed in the row, the hashes are joined with the test windows' hashes, and each hit is verified word by word
against the document before it counts. The test windows are broadcast only while their counted number is within
``broadcast_rows``; a larger benchmark is joined by shuffling hashes. The places of hits are kept in the shared folder
and go back to the texts by broadcast while their summed bytes are within ``BROADCAST_BYTES``, so no text is shuffled;
beyond, texts and places meet by a shuffle on document and text hash. Only DataFrame functions run.

Defined results: null and empty texts have no words and no hits; repeated rows each get their own result; rows that
share an id but not a text are judged apart; an item without words matches nothing; items with equal ids count once;
an empty benchmark leaves every document clean; an empty document table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.columns import NOT_ALNUM, ascii_lower, let, others, unused, whole, words
from marlstone.llm.store import written

WIDTH = 10
#: A test window is a hash, a length and its words: about 200 bytes, so this many stay under 40 MB.
BROADCAST_ROWS = 200_000
#: ... and only if their words and ids are no longer than this; so long may the places of hits be, too.
BROADCAST_BYTES = 40_000_000


def normal_words(text: Column) -> Column:
    """Lower-case A-Z, then the runs of letters, digits and characters beyond ASCII."""
    return words(ascii_lower(whole(text)), NOT_ALNUM)


def _windows(w: Column, width: int | Column) -> Column:
    """The hash of each window of so many words, in order; empty if there are fewer words."""
    return F.when(
        F.size(w) >= width,
        F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width))),
    ).otherwise(F.array().cast("array<bigint>"))


def test_windows(benchmark: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each distinct window: len, h (hash of the words), gram (the words), items (ids as strings)."""
    w = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.explode(F.array(normal_words(F.col(f"`{text}`")))).alias("w"))
    w = w.where(F.size("w") > 0).select("item", "w", F.least(F.size("w"), F.lit(width)).alias("len"))
    w = w.select(
        "item",
        "len",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))
        ).alias("g"),
    )
    return w.groupBy("len", F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram")).agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def _sent(rows: DataFrame, name: str, length: Column) -> DataFrame:
    """``rows`` kept in the shared folder, to be broadcast if their summed ``length`` is within ``BROADCAST_BYTES``."""
    rows = written(rows, name)
    held = rows.agg(F.sum(length + 64)).first()[0] or 0
    return F.broadcast(rows) if held <= BROADCAST_BYTES else rows


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Verified hits, one row for each (doc_id, th): th is the text's hash, hits an array of (start, len, items)."""
    grams = test_windows(benchmark, width)
    # at most `width` lengths exist, whatever the size of the benchmark
    held = F.sum(F.octet_length("gram") + F.octet_length(F.array_join("items", ",")) + 64)
    sizes = grams.groupBy("len").agg(F.count("*").alias("n"), held.alias("bytes")).collect()
    few = sum(r["n"] for r in sizes) <= (BROADCAST_ROWS if broadcast_rows is None else broadcast_rows)
    small = F.broadcast if few and sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES else lambda x: x
    lengths = sorted(r["len"] for r in sizes)
    base = docs.select("doc_id", F.col("text"), F.xxhash64(whole(F.col("text"))).alias("th"))
    tokens = base.select("doc_id", "th", F.explode(F.array(normal_words(F.col("text")))).alias("w"))
    if lengths:
        # windows of all lengths in one pass over a document
        def placed(n: int) -> Column:
            return F.transform(_windows(F.col("w"), n), lambda h, i: F.struct(h.alias("h"), i.alias("start"), F.lit(n).alias("len")))

        each = [placed(n) for n in lengths]
        at = tokens.select("doc_id", "th", F.explode(F.concat(*each)).alias("x")).select("doc_id", "th", "x.*")
        found = at.join(small(grams.select("len", "h").distinct()), ["len", "h"]).select("doc_id", "th", "start", "len")
    else:
        found = docs.sparkSession.createDataFrame([], "doc_id bigint, th bigint, start int, len int")
    found = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "len")).alias("maybe"))
    found = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "maybe")
    found = _sent(found, "found", F.size("maybe") * 24)
    again = base.join(found, base.doc_id.eqNullSafe(F.col("d")) & (base.th == F.col("t")))
    again = again.select("doc_id", "th", F.explode(F.array(normal_words(F.col("text")))).alias("w"), "maybe")
    hits = again.select(
        "doc_id",
        "th",
        F.explode(
            F.transform(
                "maybe",
                lambda x: F.struct(
                    x["start"].alias("start"),
                    x["len"].alias("len"),
                    F.array_join(F.slice("w", x["start"] + 1, x["len"]), " ").alias("gram"),
                ),
            )
        ).alias("x"),
    ).select("doc_id", "th", "x.*")
    hits = hits.join(small(grams.select("len", "gram", "items")), ["len", "gram"])
    return hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "len", "items")).alias("hits"))


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_rows: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted as strings), hit_words (their places) and contaminated."""
    rest = [F.col(f"`{c}`") for c in others(docs, "n_words", "n_hit", "n_items", "items", "hit_words", "contaminated")]
    d, t, i, p, h = unused(docs, "_d", "_t", "_items", "_places", "_th")
    hits = scan(docs.select("doc_id", "text"), benchmark, width, broadcast_rows).select(
        F.col("doc_id").alias(d),
        F.col("th").alias(t),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))).alias(i),
        F.array_sort(
            F.array_distinct(
                F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
            )
        ).alias(p),
    )
    hits = _sent(hits, "hits", F.size(p) * 8 + F.octet_length(F.array_join(i, ",")) + F.size(i) * 16)
    left = docs.select(*rest, F.xxhash64(whole(F.col("text"))).alias(h), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    out = left.join(hits, left.doc_id.eqNullSafe(F.col(d)) & (left[h] == F.col(t)), "left")
    items = F.coalesce(i, F.array().cast("array<string>"))
    places = F.coalesce(p, F.array().cast("array<int>"))
    return out.select(
        *rest,
        "n_words",
        F.size(places).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        places.alias("hit_words"),
        (F.size(places) > 0).alias("contaminated"),
    )


def _carried(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Ids, texts and all other columns of ``docs`` in a struct, so that none of them is replaced; and those of ``docs``."""
    (own,) = unused(docs, "_row")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None)
    return docs.select("doc_id", "text", held.alias(own)), [F.col(own)[c].alias(c) if c in rest else F.col(c) for c in docs.columns]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, **how) -> DataFrame:
    """The documents of which at most ``max_share`` of the words are hit, with the columns of ``docs``."""
    rows, own = _carried(docs)
    m = mark(rows, benchmark, **how)
    return m.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_share)).select(*own)


def cut_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` with every hit word, and the separators behind it, taken out of the text."""
    rows, own = _carried(docs)
    m = mark(rows, benchmark, **how)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*"
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all("text", F.lit(f"({word})"), F.lit(1))
    # a set of places as a map from place to itself would be searched one by one; a flag array is indexed
    flags = let(
        F.col("hit_words"),
        lambda p: F.flatten(
            F.array_append(
                F.transform(
                    p,
                    lambda x, k: F.array_append(
                        F.array_repeat(F.lit(False), x - F.when(k == 0, F.lit(-1)).otherwise(F.get(p, k - 1)) - 1), True
                    ),
                ),
                F.array_repeat(F.lit(False), F.col("n_words").cast("int") - F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(-1)) - 1),
            )
        ),
    )
    cut = F.concat(
        lead, F.array_join(F.filter(F.zip_with(pieces, flags, lambda w, hit: F.when(~hit, w)), lambda x: x.isNotNull()), "")
    )
    text = F.when(F.col("contaminated"), cut).otherwise(F.col("text"))
    return m.select(*(text.alias("text") if c == "text" else x for c, x in zip(docs.columns, own, strict=True)))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mark(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, bw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
