"""Quality rules: one threshold table compiled into one Spark projection.

Every rule is a ratio or a length of the whole text and two bounds. The table is turned into plain columns,
so a run is a scan and a projection: no shuffle, no Python on the executors.

Defined results: a null or empty text has no words, all measures are 0 and it fails the base rule; repeated rows
are judged one by one; other columns pass through ``judge`` untouched (those named like a measure are replaced);
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.columns import cover, let, others, unused, whole, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it with as on are was be by this from or "
    "der die das und in zu den mit von ist ein eine nicht auf für sich auch des dem im "
    "le la les de des et un une est en que pour dans du sur avec qui au il elle "
    "el los las y del que en por con para una se no su es al lo como más"
).split()

#: Low bits of a packed window hash that hold its place.
PLACE_BITS = 22

#: As they are written inside a sentence, at its start and in capitals.
CASED = sorted({f(x) for x in STOP_WORDS for f in (str.lower, str.title, str.upper)})

#: Fixed values: (measure, lowest, highest); None leaves a side open.
THRESHOLDS = (
    ("n_words", 50, None),
    ("mean_word", 1.5, 14.0),
    ("symbol_ratio", None, 0.25),
    ("shout_ratio", None, 0.5),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_ratio", None, 0.5),
)

SYMBOLS = "#*$%&|<>"


def measures(text: Column) -> Column:
    """An array of one struct: every measure of a text. Exploded, each part is computed once."""

    def of_words(w: Column) -> Column:
        n = F.size(w)

        triples = F.slice(F.arrays_zip(w, F.slice(w, 2, F.greatest(n, F.lit(1))), F.slice(w, 3, F.greatest(n, F.lit(1)))), 1, n - 2)

        def repeats() -> Column:
            """Words in 3-word windows that the text has twice or more.

            Window hashes, each with its place in the low bits, are sorted as plain longs; the places of equal
            neighbours are then compared as strings, so a hash that two windows share by chance counts for nothing.
            Texts with more places than the low bits hold compare all their windows as strings.
            """
            packed = F.transform(
                triples, lambda x, i: F.shiftleft(F.xxhash64(x), PLACE_BITS).bitwiseOR(i.cast("long"))
            )

            def alike(s: Column) -> Column:
                beside = F.zip_with(
                    s,
                    F.slice(s, 2, n),
                    lambda a, b: F.when(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.array(a, b)),
                )
                both = F.array_distinct(F.flatten(F.array_compact(beside)))
                return F.transform(both, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))

            def equal(s: Column) -> Column:
                twice = F.filter(
                    s,
                    lambda x, k: x["g"].eqNullSafe(F.get(s, k + 1)["g"]) | x["g"].eqNullSafe(F.get(s, k - 1)["g"]),
                )
                return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: cover(p, 3))

            some = F.when(n < 1 << PLACE_BITS, let(F.sort_array(packed), alike)).otherwise(
                F.sequence(F.lit(0), n - 3)
            )
            windows = F.transform(
                some,
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")
                ),
            )
            return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(windows), equal))

        return F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeats().cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*CASED))).cast("long").alias("n_stop"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    return F.array(
        F.struct(
            let(words(text), of_words).alias("w"),
            let(F.filter(F.split(whole(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines).alias("l"),
            F.char_length(F.regexp_replace(whole(text), f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            F.char_length(F.regexp_replace(whole(text), "[^!]+", "")).cast("long").alias("n_shouts"),
        )
    )


def compiled(thresholds=THRESHOLDS) -> Column:
    """One boolean column: every measure lies within its bounds (bounds included)."""
    tests = [F.lit(True)]
    for name, low, high in thresholds:
        if low is not None:
            tests.append(F.col(name) >= F.lit(low))
        if high is not None:
            tests.append(F.col(name) <= F.lit(high))
    return reduce(lambda a, b: a & b, tests)


RAW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DERIVED = ("n_stop", "n_lines", "mean_word", "symbol_ratio", "shout_ratio", "stop_ratio", "dup_line_ratio", "repeat_ratio")


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with every measure, ``base_failed`` and ``kept``."""
    rest = others(docs, *({*RAW, *DERIVED, "base_failed", "kept"} - {text}))
    (held,) = unused(docs, "_m")
    m = docs.select(*(F.col(f"`{c}`") for c in rest), F.explode(measures(F.col(f"`{text}`"))).alias(held))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, lines = F.col(f"{held}.w.n_words"), F.col(f"{held}.l.n_lines")
    m = m.select(
        *(F.col(f"`{c}`") for c in rest),
        n.alias("n_words"),
        F.col(f"{held}.w.word_chars").alias("word_chars"),
        F.col(f"{held}.n_symbols").alias("n_symbols"),
        F.col(f"{held}.l.n_dup_lines").alias("n_dup_lines"),
        F.col(f"{held}.w.n_repeat_words").alias("n_repeat_words"),
        F.col(f"{held}.w.n_stop").alias("n_stop"),
        lines.alias("n_lines"),
        share(F.col(f"{held}.w.word_chars"), n).alias("mean_word"),
        share(F.col(f"{held}.n_symbols"), n).alias("symbol_ratio"),
        share(F.col(f"{held}.n_shouts"), n).alias("shout_ratio"),
        share(F.col(f"{held}.w.n_stop"), n).alias("stop_ratio"),
        share(F.col(f"{held}.l.n_dup_lines"), lines).alias("dup_line_ratio"),
        share(F.col(f"{held}.w.n_repeat_words"), n).alias("repeat_ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.select("*", failed.alias("base_failed")).select(
        "*", (~F.col("base_failed") & compiled(thresholds)).alias("kept")
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the number of stop words."""
    return judge(docs.select("doc_id", "text")).select("doc_id", *RAW, "n_stop", "base_failed", "kept")


_SHARE = "CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0 END"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 2], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in CASED)})))::BIGINT AS n_stop,
  len(l) AS n_lines, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_shouts FROM d LEFT JOIN r USING (doc_id)),
x AS (SELECT *, {_SHARE.format(a="word_chars", b="n_words")} AS mean_word, {_SHARE.format(a="n_symbols", b="n_words")} AS symbol_ratio, {_SHARE.format(a="n_shouts", b="n_words")} AS shout_ratio,
  {_SHARE.format(a="n_stop", b="n_words")} AS stop_ratio, {_SHARE.format(a="n_dup_lines", b="n_lines")} AS dup_line_ratio, {_SHARE.format(a="n_repeat_words", b="n_words")} AS repeat_ratio,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, base_failed, NOT base_failed AND n_words >= 50 AND mean_word BETWEEN 1.5 AND 14 AND symbol_ratio <= 0.25
  AND shout_ratio <= 0.5 AND stop_ratio >= 0.01 AND dup_line_ratio <= 0.5 AND repeat_ratio <= 0.5 AS kept FROM x
"""
