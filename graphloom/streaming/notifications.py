"""Dataset notifications as micro-batches: the newest state of each dataset is kept from one to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import fresh_dir

SCHEMA = "metadata_id string, filename string, domain string, seq long, tables array<string>, piis array<string>"


def latest(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """One row for each file: its newest notification, the metadata_id before it, and what is carried from one to the next: how many there were, the tables it brought, the columns named as personal."""
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    new = batch.groupBy("filename").agg(F.max_by(F.struct("metadata_id", "domain", "seq"), "seq").alias("n"), F.count("*").alias("n_seen"), whole("tables"), whole("piis")).select("filename", "n.*", "n_seen", "tables", "piis")
    if state is None:
        return new.withColumn("previous_id", F.lit(None).cast("string"))
    old = state.select("filename", *(F.col(c).alias(f"o_{c}") for c in ("metadata_id", "domain", "seq", "n_seen", "tables", "piis", "previous_id")))
    both = new.join(old, "filename", "full")
    # a notification that comes late is counted, but the newest one stays
    newer = F.col("seq").isNotNull() & (F.col("o_seq").isNull() | (F.col("seq") >= F.col("o_seq")))
    pick = lambda c: F.when(newer, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
    none = F.array().cast("array<string>")
    add = lambda c: F.array_sort(F.array_union(F.coalesce(f"o_{c}", none), F.coalesce(c, none))).alias(c)
    previous = F.when(newer, F.col("o_metadata_id")).otherwise(F.col("o_previous_id"))
    return both.select("filename", pick("metadata_id"), pick("domain"), pick("seq"), (F.coalesce("n_seen", F.lit(0)) + F.coalesce("o_n_seen", F.lit(0))).alias("n_seen"), add("tables"), add("piis"), previous.alias("previous_id"))


def run(spark: SparkSession, folder: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Reads all notifications that are there, a micro-batch at a time, and returns the state after the last.

    The state after each batch is a table named by the batch's number beside the stream's own checkpoint: a batch that is run again after a failure, by this or another
    driver, starts from the table of the batch before it and replaces its own, so nothing is counted twice or forgotten.
    """

    def of(batch_id: int) -> str:
        return f"{checkpoint}/state/{batch_id}"

    def held(batch_id: int) -> DataFrame | None:
        return spark.read.parquet(of(batch_id)) if batch_id >= 0 else None

    def each(batch: DataFrame, batch_id: int) -> None:
        latest(held(batch_id - 1), batch).write.mode("overwrite").parquet(of(batch_id))

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [int(x.getPath().getName()) for x in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))] if fs.exists(path) else []
    return held(max(batches)) if batches else latest(None, spark.createDataFrame([], SCHEMA))


def demo(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Notifications made of conversations, written in two parts and read as a stream."""
    root = fresh_dir(spark, "notifications")
    rows.select(F.concat_ws("-", "conv_id", "turn").alias("metadata_id"), F.concat(F.lit("file"), (F.col("conv_id") % 7).cast("string")).alias("filename"), F.col("role").alias("domain"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.array(F.concat(F.lit("t"), (F.col("turn") % 3).cast("string"))).alias("tables"), F.when(F.col("role") == "user", F.array("role")).alias("piis")).repartition(2).write.json(f"{root}/in")
    return run(spark, f"{root}/in", f"{root}/state")
