"""From raw documents to packed training sequences: five stages, each an operator of graphloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents. Null texts count as empty
everywhere, further columns pass, an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import importance, ngram_join, packing, pii, toxicity
from graphloom.llm.common import fresh_dir, remove, table
from graphloom.llm.wordbpe import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores 1/2 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    return importance.resampled(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return ngram_join.one_of_each_class(docs)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of the same length, so n_chars stays true."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", hide_personal),
    ("best-fit packing", pack),
]

#: SQL cannot express the trained models, the tokenizer or the packing; tests/llm compares each stage with what a plainer version of it keeps or makes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = fresh_dir(spark, f"stage{k}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            if before:
                remove(spark, before)
            before = folder
    return docs
