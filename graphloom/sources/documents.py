"""Documents: file lists, whole JSON files, mapping files, results of earlier runs, abbreviation lists, tables in web pages, image tags, settings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import cut
from graphloom.sources.mappings import repair_json


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path and length of the files at any depth whose path ends with a text; their contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return rows.where(F.col("path").endswith(suffix))


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file (its name without suffix) and text of whole JSON files; objects that follow one another are repaired to an array, what is no JSON even so is left out."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    rows = rows.select("path", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("file"), repair_json(F.btrim("text", F.lit(" \t\r\n"))).alias("text"))
    return rows.where(F.try_parse_json("text").isNotNull())


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A .csv or .tsv with a header, all columns as texts; NULL, null and n/a are texts like others."""
    return spark.read.option("header", True).option("sep", "," if path.endswith(".csv") else "\t").option("inferSchema", False).option("nullValue", "\x00").csv(path)


def read_inventory(spark: SparkSession, path: str, with_itself: bool = False) -> DataFrame:
    """sf, lf of a list of abbreviations (columns SF and LF, parted by a bar), with a row that expands each short form to itself if asked."""
    rows = spark.read.option("header", True).option("sep", "|").csv(path).select(F.btrim("SF").alias("sf"), F.btrim("LF").alias("lf")).where("sf <> '' and lf <> ''")
    return (rows.unionByName(rows.select("sf", F.col("sf").alias("lf"))) if with_itself else rows).distinct()


_EXPANSIONS = "map<string,struct<tokenised:string,abbrevs:array<string>,headerCands:array<struct<headerFF:string,rank:int,localScore:double>>>>"


def expansions(rows: DataFrame, column: str = "text") -> DataFrame:
    """header, tokenised, rank, expansion of a document of header expansions; a header without candidates has one row without an expansion."""
    each = rows.select(F.explode(F.from_json(column, _EXPANSIONS)).alias("header", "v"))
    return each.select("header", "v.tokenised", F.explode_outer("v.headerCands").alias("c")).select("header", "tokenised", "c.rank", F.col("c.headerFF").alias("expansion"))


_MAPPINGS = "tables array<struct<`table`:string,mapping:struct<type:string,ontoEl:string,`match`:array<string>,path:array<string>>,columns:array<struct<`column`:string,isPii:boolean,mappings:array<struct<type:string,ontoEl:string,`match`:array<string>,path:array<string>>>>>>>"


def mapping_rows(rows: DataFrame, column: str = "text") -> DataFrame:
    """table, column (null for the table's own), is_pii, type, element, match, path of a mappings document."""
    tables = rows.select(F.explode(F.from_json(column, _MAPPINGS)["tables"]).alias("t"))
    pick = lambda m: (F.col(f"{m}.type"), F.col(f"{m}.ontoEl").alias("element"), F.col(f"{m}.match"), F.col(f"{m}.path"))
    own = tables.select(F.col("t.table"), F.lit(None).cast("string").alias("column"), F.lit(False).alias("is_pii"), *pick("t.mapping"))
    columns = tables.select(F.col("t.table"), F.explode("t.columns").alias("c")).select("table", F.col("c.column"), F.coalesce("c.isPii", F.lit(False)).alias("is_pii"), F.explode("c.mappings").alias("m"))
    return own.unionByName(columns.select("table", "column", "is_pii", *pick("m")))


class _Tables(HTMLParser):
    """The cells of the first table of a class: rows of texts, line breaks as such."""

    def __init__(self, cls: str):
        super().__init__()
        self.cls, self.depth, self.done, self.rows, self.cell = cls, 0, False, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table" and not self.done and (self.depth or not self.cls or self.cls in (dict(attrs).get("class") or "").split()):
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = []
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self.cell)
        elif tag in ("br", "li", "p") and self.cell:
            self.cell.append("\n")

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = not self.depth
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and self.depth == 1:
            self.cell.append(data)


def page_tables(pages: DataFrame, key: str = "page_id", html: str = "html", cls: str = "wikitable") -> DataFrame:
    """key, sf, lf of the first table of a class on each page: the header row is left out, the second cell's lines are a row each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, text in zip(f[key], f[html], strict=True):
                p = _Tables(cls)
                p.feed(text or "")
                for row in p.rows[1:]:
                    cells = ["".join(c) for c in row]
                    if len(cells) >= 2 and cells[0].strip():
                        out += [(k, cells[0].strip(), x.strip()) for x in cells[1].split("\n") if x.strip()]
            yield pd.DataFrame(out, columns=[key, "sf", "lf"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, sf string, lf string")


_TAGS = "map<string,struct<vr:string,`Value`:array<string>>>"


def image_tags(files: DataFrame) -> DataFrame:
    """file, path, tag, vr, value of decoded image headers in their JSON form ({tag: {vr, Value}}), sequences at any depth. files: file, text; path: the tags and item numbers above, parted by slashes."""
    level = files.select("file", F.lit("").alias("path"), F.col("text").alias("t"))
    out = None
    while True:
        rows = cut(level.select("file", "path", F.explode(F.from_json("t", _TAGS)).alias("tag", "x")).select("file", "path", "tag", F.col("x.vr").alias("vr"), F.col("x.Value").alias("v")))
        plain = rows.where("vr <> 'SQ'").select("file", "path", "tag", "vr", F.explode_outer("v").alias("value"))
        out = plain if out is None else out.unionByName(plain)
        level = rows.where("vr = 'SQ'").select("file", F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), "tag").alias("path"), F.posexplode("v").alias("i", "t")).select("file", F.concat_ws("/", "path", F.col("i").cast("string")).alias("path"), "t")
        if level.isEmpty():
            return out


def best_checkpoint(states: DataFrame) -> DataFrame:
    """folder and metric of the best of the trainer states that checkpoint folders hold. states: path, text."""
    rows = states.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.get_json_object("text", "$.best_metric").try_cast("double").alias("metric"))
    return rows.where("metric is not null").orderBy(F.desc("metric"), "folder").limit(1)


def load_settings(path: str) -> dict:
    """A settings file: .json, or .yaml where a reader for it is installed. Pickled files run code when they are read, so they aren't."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("no reader for .yaml is installed; use .json") from e
            return yaml.safe_load(f)
    raise ValueError(f"settings must be .json or .yaml: {path}")
