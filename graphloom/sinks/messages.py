"""Messages and uploads: rows are sent by the tasks that hold them, each batch a limited number of times."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.kg import ntriples

#: Attempts of a message, and attempts and pause (seconds) until a topic is there.
ATTEMPTS, TOPIC_ATTEMPTS, TOPIC_PAUSE = 4, 10, 5.0


def batches(rows: Iterable, size: int) -> Iterator[list]:
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def attempted(send: Callable[[list], None], batch: list, attempts: int = ATTEMPTS, pause: float = 0.0) -> int:
    """Sends a batch, again after an error, at most so many times; the number of attempts it took. The last error is raised."""
    for k in range(1, attempts + 1):
        try:
            send(batch)
            return k
        except Exception:
            if k == attempts:
                raise
            time.sleep(pause)
    raise ValueError("no attempt allowed")


def publish(df: DataFrame, send: Callable[[list], None], column: str = "value", size: int = 100, attempts: int = ATTEMPTS) -> None:
    """Every row's text goes out once at least: a task that is lost and run again sends its rows again, so receivers tell repeated ones apart by their ids."""

    def each(rows: Iterator) -> None:
        for batch in batches((r[0] for r in rows), size):
            attempted(send, batch, attempts)

    df.select(column).foreachPartition(each)


def publish_to_topic(df: DataFrame, servers: str, topic: str, column: str = "value") -> None:
    """The same through Spark's own Kafka writer, where its connector is on the class path; it does its own attempts."""
    df.select(F.col(column).cast("string").alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.retries", str(ATTEMPTS - 1)).save()


def until_there(create: Callable[[], None], attempts: int = TOPIC_ATTEMPTS, pause: float = TOPIC_PAUSE) -> int:
    """Makes what messages go to, such as a topic, trying again after a pause; the number of attempts it took."""
    return attempted(lambda _: create(), [], attempts, pause)


def upload(t: DataFrame, send: Callable[[list], None], size: int = 1_000) -> None:
    """A graph to a store that takes updates of N-Triples lines, a batch at a time (such as the body of INSERT DATA). Triples of a graph are a set, so a batch that is sent twice does no harm."""
    publish(ntriples(t), send, "line", size)


def insert_data(lines: list[str], graph: str | None = None) -> str:
    """The update text of a batch of N-Triples lines."""
    body = "\n".join(lines)
    return f"INSERT DATA {{ GRAPH <{graph}> {{\n{body}\n}} }}" if graph else f"INSERT DATA {{\n{body}\n}}"


def load_tables(tables: dict[str, DataFrame], order: list[str], deferred: DataFrame, url: str, properties: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Appends tables to a database in the given order; columns that point to tables that aren't there yet are left null. The result names the columns left, by table, to be updated afterwards."""
    left: dict[str, list[str]] = {}
    for r in deferred.collect():  # a row for each foreign key that can't be written at once
        left.setdefault(r.table, []).append(r.column)
    for name in order:
        if name in tables:
            df = tables[name]
            for c in left.get(name, []):
                if c in df.columns:
                    df = df.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
            df.write.mode("append").jdbc(url, name, properties=properties or {})
    return left


def updates(df: DataFrame, table: str, keys: list[str], columns: list[str]) -> DataFrame:
    """The statements that fill in the columns left, one for each row that has a value there."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    sets = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} = "), quoted(c))) for c in columns]
    where = F.concat_ws(" AND ", *(F.concat(F.lit(f"{k} = "), quoted(k)) for k in keys))
    return df.select(F.concat(F.lit(f"UPDATE {table} SET "), F.concat_ws(", ", *sets), F.lit(" WHERE "), where).alias("statement")).where(F.contains("statement", F.lit("=")) & ~F.contains("statement", F.lit("SET  WHERE")))


def file_sender(folder: str) -> Callable[[list], None]:
    """A sender that writes each batch to a file of its own: for tests, and for stores that load from a folder all machines share."""

    def send(batch: list) -> None:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}.txt", "w", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in batch)

    return send


def landing(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """path, length and modificationTime of the files that a download has put into the landing folder, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length", "modificationTime")
