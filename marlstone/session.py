"""One place that builds a session with the settings every operator relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; an existing session is returned as it is.

    ``conf`` holds further settings with ``__`` for dots, e.g. ``spark__driver__memory="8g"``.
    """
    b = SparkSession.builder.appName(app)
    master = master or os.environ.get("MARLSTONE_MASTER")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """The named table below ``sf_dir``; any path that Spark itself can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors of this session, once; their Python need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        import tempfile
        import zipfile
        from pathlib import Path

        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode.

    A cluster must set it: a folder of one machine would be invisible to the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        at = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")
