"""What the operators of this subpackage share: tables, whole texts, batches, the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 512
#: What operators keep in a Python worker from batch to batch, by operator.
_kept: dict[str, dict] = {}
#: Only the GNU C library has it, and needs it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as it is; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what text operators need, so that further columns of any name do no harm."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Sets the session's batch size, for good: plans read it when they run, after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def kept(owner: str, cache: dict) -> dict:
    """The cache, known to alone()."""
    _kept[owner] = cache
    return cache


def alone(owner: str) -> None:
    """A Python worker serves the operators of a job one after the other; what it kept for others goes, else their caches add up."""
    for name, cache in _kept.items():
        if name != owner and cache:
            cache.clear()


def give_back() -> None:
    """Memory that is free but held by the allocators goes back to the system; idle workers stand beside the JVM in an executor's limit."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, that gives memory back after each batch and at its end."""

    def tidied(batches):
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session, where both are one process, may name none and gets one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: the rows are written to the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]
