"""Files: tables, graphs, JSON documents, mapping reports. All but single documents are written by as many tasks as there are rows for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.kg import ntriples
from graphloom.sources.rdf import turtle_lines


def write_table(df: DataFrame, path: str) -> None:
    """A processed table as CSV with a header; empty texts and nulls stay apart, line breaks and quotes survive."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The same table back, all columns as texts."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(path)


def write_graph(t: DataFrame, path: str, by: str | None = None) -> None:
    """A graph as N-Triples, in a folder for each value of a column if asked (such as the table that a triple comes from)."""
    out = ntriples(t, by)
    (out.write.mode("overwrite").partitionBy(by) if by else out.write.mode("overwrite")).text(path)


def write_turtle(t: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """A graph as one Turtle file, prefixes first: for ontologies, which are read whole. Graphs of rows are written as N-Triples."""
    turtle_lines(t, prefixes).orderBy("n", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


def merged(*graphs: DataFrame) -> DataFrame:
    """Several graphs as one; a triple that more than one has stands once."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return out.distinct()


def as_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Each row as a JSON text, nulls written out."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false", "pretty": "true"}).alias(column))


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object on each line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_mappings(rows: DataFrame, path: str) -> None:
    """SrcEntity, TgtEntity, Score as a TSV with a header; added to what is there, so that a run that was stopped goes on."""
    rows.select(F.col("src").alias("SrcEntity"), F.col("tgt").alias("TgtEntity"), F.col("score").alias("Score")).write.mode("append").option("header", True).option("sep", "\t").csv(path)


def unfinished(sources: DataFrame, path: str) -> DataFrame:
    """The sources that the mappings written so far don't have. sources: src."""
    spark = sources.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return sources
    done = spark.read.option("header", True).option("sep", "\t").csv(path).select(F.col("SrcEntity").alias("src")).distinct()
    return sources.join(done, "src", "left_anti")


def corpus_document(corpus: DataFrame) -> DataFrame:
    """kind, n and the pairs of a training corpus, a row for synonyms and one for others, each written as lines. corpus: a, b, is_synonym."""
    return corpus.select(F.when(F.col("is_synonym"), "synonyms").otherwise("nonsynonyms").alias("kind"), "a", "b")


def write_corpus(corpus: DataFrame, path: str) -> None:
    """The pairs by kind, and a summary of their numbers beside them."""
    corpus_document(corpus).write.mode("overwrite").partitionBy("kind").json(f"{path}/pairs")
    corpus_document(corpus).groupBy("kind").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def score_lines(scores: DataFrame) -> DataFrame:
    """One line for each tested pair: its source and the scores of its candidates in their order. scores: src, position, score."""
    lists = scores.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "score"))), lambda x: x["score"].cast("string")).alias("s"))
    return lists.select(F.concat_ws(",", F.col("src"), F.array_join("s", ",")).alias("line"))


def mapping_report(mappings: DataFrame) -> DataFrame:
    """Table, Column, Match: the local name of each match, or the column's own name where it has none. mappings: table, column, match (array)."""
    name = F.regexp_extract("m", r"([^/#]*)$", 1)
    return mappings.select("table", "column", F.explode_outer("match").alias("m")).select(F.col("table").alias("Table"), F.col("column").alias("Column"), F.when(F.col("m").isNull(), F.col("column")).otherwise(name).alias("Match"))


def cached(spark: SparkSession, folder: str, make) -> DataFrame:
    """What the folder holds; made and written there if it holds nothing whole yet."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
