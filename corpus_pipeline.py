"""The training-data pipeline: five stages over documents, each on all that the stage before has kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty result of the same columns, and extra columns are left
behind. Null and empty texts are rejected by the first stage, as they have fewer than 50 words; where a later stage is
given one, it stays, is linked with nothing, has no entities, and gets null ids (null) or none (empty). Whole texts are
worked on, however long. Repeated rows of an id and text are judged alike; the second stage keeps one of them, and of a
group the smallest id, then the smallest hash of the text. A null id is no reason to drop a row, but a row without one
stays only if no copy of it has an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, pieces, pii, quality, setjoin
from marlstone.llm.store import written
from marlstone.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.judge(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return setjoin.drop_duplicates(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the new text."""
    out = pii.anonymise(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every document, with merge-dropout."""
    coded = pieces.encode(docs.select("doc_id", "text")).select("doc_id", "ids")
    return coded.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("sentence_pieces", sentence_pieces),
]

#: Merge-dropout cannot be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
