"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from marlstone.llm import dac, decontaminate, divergence, linededup, negatives, pieces, pii, quality, secretscan, setjoin, substrings, toxicity, urllists
from marlstone.session import table

QUERIES = {
    "op1_secret_scan": lambda spark, d: secretscan.digest(table(spark, d, "documents")),
    "op2_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_url_lists": lambda spark, d: urllists.digest(table(spark, d, "pages")),
    "op4_substrings": lambda spark, d: substrings.digest(table(spark, d, "documents")),
    "op5_quality_rules": lambda spark, d: quality.digest(table(spark, d, "documents")),
    "op6_pieces": lambda spark, d: pieces.digest(table(spark, d, "documents")),
    "op7_decontaminate": lambda spark, d: decontaminate.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_pii": lambda spark, d: pii.digest(table(spark, d, "documents")),
    "op9_dac": lambda spark, d: dac.digest(table(spark, d, "documents")),
    "op10_jaccard_join": lambda spark, d: setjoin.digest(table(spark, d, "documents")),
    "op11_hard_negatives": lambda spark, d: negatives.digest(table(spark, d, "embeddings")),
    "op12_source_divergence": lambda spark, d: divergence.digest(table(spark, d, "documents")),
    "op13_line_dedup": lambda spark, d: linededup.digest(table(spark, d, "documents")),
}

ORACLES: dict = {
    "op3_url_lists": urllists.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_jaccard_join": setjoin.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_line_dedup": linededup.ORACLE,
}
