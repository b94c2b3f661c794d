"""Tables that a job keeps in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from marlstone.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: its lineage ends there, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder, and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
