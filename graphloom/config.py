"""Settings, and the places where a caller's own parts go in."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.alignment import SCORERS, TOKENIZERS, Settings, preset


@dataclass(frozen=True)
class Config:
    """How a dataset becomes a graph. Thresholds are shares; BES ones are percent."""

    dataset: str = "Dataset"
    domain: str = "default"
    base: str = "urn:graphloom:"
    root: str = "Record"
    attributes_to_classes: bool = True
    expand_abbreviations: bool = False
    mapper: str = "scored"
    bes_high: float = 80.0
    bes_low: float = 50.0
    bes_reject: float = 40.0
    pj_high: float = 0.5
    pj_reject: float = 0.3
    depth: int = 2
    cross_map: bool = True

    @classmethod
    def of(cls, text: str) -> Config:
        """From a JSON text; unknown names are an error, missing ones keep their defaults."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    def text(self) -> str:
        return json.dumps(asdict(self))

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    @property
    def alignment(self) -> Settings:
        return preset(self.domain)


class Connector(Protocol):
    """Where tables come from."""

    def tables(self) -> list[str]: ...

    def read(self, table: str) -> DataFrame: ...

    def catalog(self) -> DataFrame: ...


class FolderConnector:
    """Tables as Parquet files in a folder."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str]):
        self.spark, self.folder, self.names = spark, folder, names

    def tables(self) -> list[str]:
        return list(self.names)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def catalog(self) -> DataFrame:
        rows = [(t, f.name) for t in self.names for f in self.read(t).schema.fields]
        return self.spark.createDataFrame(rows, "table string, column string")


class FormatRules(Protocol):
    """What a format adds to the mappings of its tables; each part may return what it is given."""

    def additional_matches(self, matches: DataFrame) -> DataFrame: ...

    def new_mappings(self, mappings: DataFrame) -> DataFrame: ...

    def modified(self, mappings: DataFrame) -> DataFrame: ...


class NoRules:
    """The rules of a format that has none."""

    def additional_matches(self, matches: DataFrame) -> DataFrame:
        return matches

    def new_mappings(self, mappings: DataFrame) -> DataFrame:
        return mappings

    def modified(self, mappings: DataFrame) -> DataFrame:
        return mappings


def with_rules(rules: FormatRules, matches: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches and mappings once a format's rules went over them, in their order."""
    return rules.additional_matches(matches), rules.modified(rules.new_mappings(mappings))


class Dictionary:
    """Codes with names and further labels, as a frame: code, name, label (one row for each label)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def named(self, df: DataFrame, column: str) -> DataFrame:
        """The rows with the name of a column's code in its place; codes without one stay."""
        names = self.rows.groupBy(F.col("code").alias("__code")).agg(F.min("name").alias("__name"))
        return df.join(names, df[column] == F.col("__code"), "left").withColumn(column, F.coalesce("__name", column)).drop("__code", "__name")

    def labels(self) -> DataFrame:
        return self.rows.where("label is not null").select("code", "label").distinct()


#: How a dataset's format becomes an ontology: name to a function of (spark, rows, config).
EXTRACTORS: dict[str, Callable] = {}
#: Negative candidates by strategy: name to a function of (references, pool, k).
SAMPLERS: dict[str, Callable] = {}
#: What joins the values of a group: name to a function of a column.
AGGREGATES: dict[str, Callable] = {"max": F.max, "min": F.min, "mean": F.avg, "list": lambda c: F.array_sort(F.collect_list(c)), "set": lambda c: F.array_sort(F.collect_set(c))}


def register(where: dict[str, Callable], name: str):
    """Puts a function under a name into one of the tables above."""

    def put(f: Callable) -> Callable:
        where[name] = f
        return f

    return put


@register(EXTRACTORS, "tabular")
def _tabular(catalog: DataFrame, config: Config) -> dict[str, DataFrame]:
    from graphloom.operators import rules

    return {"classes": rules.classes(catalog), "object_properties": rules.object_property_rules(catalog), "data_properties": rules.data_property_rules(catalog, config.attributes_to_classes)}


@register(EXTRACTORS, "json")
def _json(files: DataFrame, config: Config) -> dict[str, DataFrame]:
    from graphloom.operators import json_graph

    nodes = json_graph.walk(files, config.root)
    return {"ontology": json_graph.ontology(nodes), "tables": json_graph.table_paths(nodes)}


def extract(kind: str, rows: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The parts of the extracted ontology of rows in a format."""
    if kind not in EXTRACTORS:
        raise ValueError(f"no extractor for {kind}; there are {sorted(EXTRACTORS)}")
    return EXTRACTORS[kind](rows, config)


def aggregated(df: DataFrame, by: list[str], how: dict[str, str]) -> DataFrame:
    """One row for each group, each column joined in the way named for it."""
    return df.groupBy(*by).agg(*(AGGREGATES[w](F.col(c)).alias(c) for c, w in how.items()))


MAPPERS = ("exact", "scored")


def mapped(mapper: str, src: DataFrame, tgt: DataFrame, how: Settings) -> DataFrame:
    """src, tgt, score by the mapper named: equal labels only, or the whole alignment. src, tgt: entity, label."""
    from graphloom.operators import alignment, matching

    if mapper == "exact":
        return matching.exact_match(src, tgt)
    if mapper == "scored":
        return alignment.predict(src, tgt, how).select("src", "tgt", "score")
    raise ValueError(f"no mapper {mapper}; there are {MAPPERS}")


__all__ = ["AGGREGATES", "EXTRACTORS", "MAPPERS", "SAMPLERS", "SCORERS", "TOKENIZERS", "Config", "Connector", "Dictionary", "FolderConnector", "FormatRules", "NoRules", "aggregated", "extract", "mapped", "register", "with_rules"]
