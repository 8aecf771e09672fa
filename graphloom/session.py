"""Session defaults, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session, where both are one process, may name none and gets one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with a number where the frame has such a column already."""
    taken = {c.lower() for c in df.columns}
    return [next(c for c in (f"{n}{i or ''}" for i in range(len(taken) + 1)) if c.lower() not in taken) for n in names]
