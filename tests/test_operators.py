from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import registry
from graphloom.functions import text as X
from graphloom.operators import hierarchy as H, matching as M
from graphloom.sources.tabular import read, repaired, with_surrogate_key

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(v):
    return round(v, 9) if isinstance(v, float) else str(v)


NAMES = sorted(set(registry.queries()) & set(registry.oracle_sql()))


@pytest.fixture(scope="module")
def answers(spark):
    """Every query's columns and rows, several queries at a time: most of a small query's time is planning."""

    def run(name):
        df = registry.queries()[name](spark, SF)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        found = {name: pool.submit(run, name) for name in NAMES}
        yield found
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(answers, duck, name):
    rel = duck.sql(registry.oracle_sql()[name])
    columns, rows = answers[name].result()
    assert sorted(columns) == sorted(rel.columns)
    assert sorted(tuple(same(r[c]) for c in rel.columns) for r in rows) == sorted(tuple(map(same, r)) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_counts_each_notification_once(spark):
    rows = registry.queries()["notification_stream"](spark, SF).collect()
    assert sum(r.n_seen for r in rows) == spark.read.parquet(f"{SF}/conversations.parquet").count()


def test_headers_do_not_collide():
    assert repaired(["a", "a_2", "a"], 3) == ["a", "a_2", "a_3"] and len(set(repaired(["a_2", "a", "a", ""], 6))) == 6


def test_ragged_file_with_pipe(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a|b|b\n1|2\n3|4|5|6\n")
    got = read(spark, str(tmp_path / "x.txt"))
    assert got.columns == ["a", "b", "b_3", "Unknown_Header_1"] and sorted(map(tuple, got.collect())) == [("1", "2", "", ""), ("3", "4", "5", "6")]


def test_surrogate_key_is_dense(spark):
    got = with_surrogate_key(spark.range(1000), "id").collect()
    assert all(r.PKCol == str(r.id + 1) for r in got)


def test_closure_of_a_cycle_has_least_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "child string, parent string")
    assert {(r.node, r.ancestor): r.depth for r in H.closure(e).collect()}[("a", "c")] == 1


def test_union_find_example(spark):
    got = H.connected(spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (8, 9)], "a int, b int")).collect()
    assert {r.node: r.comp for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 8: 8, 9: 8}


def test_suitability_scan_against_a_loop(spark):
    import random

    r = random.Random(3)
    rows = [(s, p, r.randint(1, 5), round(r.random(), 3)) for s in range(20) for p in range(1, 8)]
    want = set()
    for s in range(20):
        least, best, kept = 1 << 31, None, 0
        for _, p, rank, score in sorted(x for x in rows if x[0] == s):
            if not kept or rank <= least or abs(score - best) <= 0.2 * best:
                best, least, kept = score if not kept else best, min(least, rank), kept + 1
                want.add((s, p))
    got = M.suitable(spark.createDataFrame(rows, "src int, pos int, rank int, score double"), 0.2).collect()
    assert {(x.src, x.pos) for x in got} == want


def test_idf_pool_against_brute_force(spark, tmp_path):
    import math

    docs = {i: "the old " + ("red " if i % 2 else "") + ("blue " if i % 3 else "") + f"w{i % 7}" for i in range(1, 31)}
    items = {1: "red blue", 2: "the w3", 3: "blue blue w5"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = lambda t: sum(t in x.split() for x in docs.values())
    want = set()
    for src, text in items.items():
        scores = {i: round(sum(math.log10(len(docs) / df(t)) for t in text.split() if t in x.split()), 6) for i, x in docs.items() if set(text.split()) & set(x.split())}
        want |= {(src, i, k + 1) for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:10])}
    got = registry.queries()["idf_pool"](spark, str(tmp_path)).collect()
    assert {(r.src, r.entity, r["rank"]) for r in got} == want and {r.src for r in got} == {1, 2, 3}


def test_fuzzy_ratios(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("rate", "interest rate"), ("", "")], "a string, b string")
    got = [(round(r[0]), round(r[1])) for r in df.select(X.ratio("a", "b"), X.partial_ratio("a", "b")).collect()]
    assert got == [(75, 75), (47, 100), (100, 100)]
