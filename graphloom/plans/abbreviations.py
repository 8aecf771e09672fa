"""Queries of header tokens and abbreviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.headers import tokenised
from graphloom.operators import abbreviations as A
from graphloom.registry import query, table

_LEXICON = ("patient", "date", "of", "birth", "blood", "pressure", "level", "omega", "key", "name", "end", "over")
#: header, tokens, tags, entries.
_CASES = (
    ("patient_birthdate", "patient|birth|date", "WORD|WORD|WORD", "patient_birthdate|patient|birth|date"),
    ("omega-3 level", "omega|3|level", "WORD|NUM|WORD", "omega-3 level|omega|omega-3|3 level|level"),
    ("dateOfBirth", "date|Of|Birth", "WORD|STOPWORD|WORD", "dateOfBirth|date|Birth"),
    ("BPxq", "BP|xq", "UNK|UNK", "BPxq"),
    ("", "", "", ""),
)


@query("header_tokens", "SELECT * FROM (VALUES " + ", ".join(f"{c}" for c in _CASES) + ") v(header, tokens, tags, entries)")
def _(s, d):
    h = s.createDataFrame([(c[0],) for c in _CASES], "header string").withColumn("t", tokenised(F.col("header"), _LEXICON))
    return h.select("header", *(F.array_join(f"t.{c}", "|").alias(c) for c in ("tokens", "tags", "entries")))


def _inventory(s, d):
    return table(s, d, "part").select(F.left("p_name", F.lit(2)).alias("sf"), F.col("p_name").alias("lf")).distinct()


@query(
    "abbrev_lookups",
    """SELECT DISTINCT p_type AS header, left(p_type, 2) AS abbrev, lf FROM part JOIN (SELECT DISTINCT left(p_name, 2) AS sf, p_name AS lf
FROM part) ON lower(sf) = lower(left(p_type, 2))""",
)
def _(s, d):
    headers = table(s, d, "part").select(F.col("p_type").alias("header"), F.array(F.left("p_type", F.lit(2)), F.lit("?")).alias("entries")).distinct()
    return A.lookups(headers, _inventory(s, d))


@query(
    "longest_prefix",
    """WITH i AS (SELECT DISTINCT left(p_name, k) AS sf FROM part, unnest([1, 3]) u(k)) SELECT p_name AS word, max(sf) AS sf
FROM (SELECT DISTINCT p_name FROM part) JOIN i ON starts_with(p_name, sf) GROUP BY 1""",
)
def _(s, d):
    names = table(s, d, "part").select("p_name").distinct()
    return A.longest_prefix(names.select(F.col("p_name").alias("word")), names.select(F.explode(F.array(F.left("p_name", F.lit(1)), F.left("p_name", F.lit(3)))).alias("sf")))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("v"))


_SCORED_SQL = """sc AS (SELECT a.label::VARCHAR AS abbrev, a.vec_id::VARCHAR AS lf, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.label)"""


@query("abbrev_similarity", f"WITH {_SCORED_SQL} SELECT abbrev, lf, round(score, 6) AS score FROM sc")
def _(s, d):
    found = table(s, d, "embeddings").select(F.lit("h").alias("header"), F.col("label").cast("string").alias("abbrev"), F.col("vec_id").cast("string").alias("lf"))
    return A.similarities(found, _vectors(s, d)).select("abbrev", "lf", F.round("score", 6).alias("score"))


@query(
    "abbrev_seed_scores",
    """WITH s AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 = 0) SELECT e.label::VARCHAR AS abbrev, e.vec_id::VARCHAR
AS lf, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], s.v)), 6) AS seed_score FROM embeddings e
JOIN s ON s.label <> e.label GROUP BY ALL""",
)
def _(s, d):
    e = table(s, d, "embeddings").select(F.col("label").cast("string").alias("abbrev"), F.col("vec_id").cast("string").alias("lf"), (F.col("vec_id") % 5 == 0).alias("sure"))
    return A.seed_scores(e, e.where("sure").select("abbrev", "lf"), _vectors(s, d)).select("abbrev", "lf", F.round("seed_score", 6).alias("seed_score"))


_SC = (("h1", "bp", "blood pressure", 0.9, 0.95), ("h2", "bp", "blood pressure", 0.9, 0.80), ("h1", "bp", "boiling point", 0.84, 0.5), ("h3", "dob", "date of birth", 0.2, 0.83), ("h4", "x", "unknown", 0.1, 0.1), ("h5", "lvl", "level", 0.86, 0.86))
_SC_SQL = "sc AS (SELECT * FROM (VALUES " + ", ".join(map(str, _SC)) + ") v(header, abbrev, lf, score, local))"


@query(
    "abbrev_filter_rounds",
    f"""WITH {_SC_SQL}, k AS (SELECT *, max(local) OVER (PARTITION BY abbrev, lf) AS m FROM sc WHERE local > 0.82 OR score > 0.82)
SELECT header, abbrev, lf FROM k WHERE m >= 0.85 OR score >= 0.85""",
)
def _(s, d):
    return A.filtered(s.createDataFrame(_SC, "header string, abbrev string, lf string, score double, local double")).select("header", "abbrev", "lf")


@query("abbrev_seeds", "SELECT * FROM (VALUES ('bp', 'blood pressure'), ('lvl', 'level')) v(abbrev, lf)")
def _(s, d):
    return A.seeds(s.createDataFrame(_SC, "header string, abbrev string, lf string, score double, local double"))


@query("abbrev_votes", "SELECT * FROM (VALUES ('bp', 'blood pressure'), ('bp', 'pressure, blood'), ('lvl', 'level'), ('lvl', 'lovely')) v(abbrev, lf)")
def _(s, d):
    """Near duplicates vote together; a tie elects both."""
    votes = s.createDataFrame([("bp", "blood pressure"), ("bp", "pressure, blood"), ("bp", "boiling point"), ("lvl", "level"), ("lvl", "lovely")], "abbrev string, lf string")
    return A.elected(votes, A.duplicate_groups(votes))


@query("header_votes", "SELECT header, abbrev, lf FROM (VALUES ('h1','bp','a'), ('h1','bp','b'), ('h2','bp','a'), ('h2','bp','a')) v(header, abbrev, lf)")
def _(s, d):
    rows = [("h1", "bp", "a", 0.9, 0.1, 0.1), ("h1", "bp", "b", 0.5, 0.7, 0.8), ("h2", "bp", "a", 0.9, 0.9, 0.9), ("h2", "bp", "b", 0.5, 0.2, 0.2)]
    return A.header_votes(s.createDataFrame(rows, "header string, abbrev string, lf string, score double, context double, seed_score double"))
