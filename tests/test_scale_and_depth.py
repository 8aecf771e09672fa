"""Rows beyond one partition, and chains, trees and cycles beyond any fixed number of steps."""

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import corpora as C, hierarchy as H, json_graph as J, kg, matching as M, profile as P
from graphloom.sources import json_tree
from graphloom.sources.mappings import parse_ntriples
from graphloom.sources.tabular import with_surrogate_key


def test_surrogate_key_of_many_rows(spark):
    rows = spark.range(500_000).select(F.col("id").alias("a"), F.xxhash64("id").alias("b"), F.lit("x").alias("__place"), (F.col("id") % 7).alias("c"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    for order in ("b", ["c", "b"]):
        got = with_surrogate_key(rows, order).withColumn("n", F.col("PKCol").cast("long"))
        assert got.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first() == (500_000, 500_000, 1, 500_000)
        assert got.columns[:4] == rows.columns
    few = [(r.b, int(r.PKCol)) for r in with_surrogate_key(rows.limit(1_000), "b").collect()]
    assert [n for _, n in sorted(few)] == list(range(1, 1_001))


def test_a_chain_of_200_levels(spark):
    chain = spark.range(200).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    got = H.closure(chain, reflexive=False)
    assert got.count() == 200 * 201 // 2 and got.where("depth <> node - ancestor").isEmpty()
    kept = H.prune(chain, spark.range(1, 200).select(F.col("id").alias("node")))
    assert [tuple(r) for r in kept.collect()] == [(200, 0)]
    parts = H.connected(chain.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    assert parts.count() == 201 and parts.select("comp").distinct().count() == 1
    short = spark.range(40).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    labels = spark.range(41).select(F.col("id").alias("entity"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("label"))
    assert {r.node: r.path for r in C.upward_path(short, labels).collect()}[40] == " <SEP> ".join(f"n{i}" for i in range(40, -1, -1))


def test_cycles_end(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "child string, parent string")
    labels = spark.createDataFrame([(x, x) for x in "abcx"], "entity string, label string")
    assert {r.node: r.path for r in C.upward_path(ring, labels).collect()} == {"a": "a <SEP> b <SEP> c", "b": "b <SEP> c <SEP> a", "c": "c <SEP> a <SEP> b", "x": "x <SEP> a <SEP> b <SEP> c"}
    assert H.prune(ring, spark.createDataFrame([("a",), ("b",), ("c",)], "node string")).isEmpty()


def test_json_of_20_levels(spark):
    deep = '{"a":' * 20 + "1" + "}" * 20
    got = json_tree.paths(spark.createDataFrame([(deep,), ('{"b": null}',), ('{"b": null, "c": [1, 2.5]}',)], "j string"), "j", "R").collect()
    assert {(r.path, r.type) for r in got} == {("/R" + "/a" * 20, "xsd:integer"), ("/R/b", "xsd:string"), ("/R/c", "xsd:integer"), ("/R/c", "xsd:decimal")}
    nodes = J.walk(spark.createDataFrame([("f", '{"z": 0, "a": ' + deep + "}")], "file string, text string")).collect()
    assert max(r.path.count("/") for r in nodes) == 22 and sum(r.kind == "value" for r in nodes) == 2


def test_json_walk_of_mixed_and_nested_arrays(spark):
    text = '{"m": [1, {"x": 2}], "n": [[1, 2], [3]], "p": [{"q": "a"}, {"q": null}, {"q": "b"}], "e": []}'
    nodes = J.walk(spark.createDataFrame([("f", text)], "file string, text string"))
    got = sorted((r.label, r.value, r.type) for r in nodes.where("kind = 'value'").collect())
    assert got == [("Record0_m0", "1", "xsd:string"), ("Record0_m1", '{"x":2}', "xsd:string"), ("Record0_n0", "1", "xsd:integer"), ("Record0_n1", "2", "xsd:integer"), ("Record0_n2", "3", "xsd:integer"), ("Record0_p0_q0", "a", "xsd:string"), ("Record0_p2_q1", "b", "xsd:string")]
    assert {(r.p, r.o) for r in J.triples(nodes).where("s = 'urn:graphloom:Record0'").collect()} >= {("p_Record_p", "urn:graphloom:Record0_p1"), ("SourceFile", "f")}


def test_rows_with_awkward_keys_and_literals_survive_as_lines(spark):
    rows = spark.createDataFrame([("a", None, "x\ty\n\"z\"\\"), ("a|", "b", "1"), ("a", "|b", "2"), (None, "a", None)], "k string, l string, v string")
    t = kg.triples("t", rows, 0, ["k", "l"], {"v": "string"}, {}, {})
    assert t.select("s").distinct().count() == 4
    lines = kg.ntriples(t)
    assert lines.where("line like '%\n%'").isEmpty()
    back = parse_ntriples(lines, "line").where("o_kind = 'lit'")
    assert {r.o for r in back.collect()} == {"x\ty\n\"z\"\\", "1", "2"}


def test_endings_are_looked_up(spark):
    names = spark.createDataFrame([("t", "home_mail"), ("t", "mail"), ("t", "mailing"), ("t", "")], "table string, column string")
    assert sorted(r.column for r in kg.ends_in(names, "column", spark.createDataFrame([("mail",), ("x",)], "suffix string")).collect()) == ["home_mail", "mail"]


def test_similarities_against_plain_ones(spark):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    words = ["", "a", "patient", "patients name", "name patient", "nam", "äöü", "birth date", "date of birth"]
    for a in words:
        for b in words:
            assert X._common(a, b) == common(a, b)
            x, y = sorted((a, b), key=len)
            plain = max((200 * common(x, y[i : i + len(x)]) / (2 * len(x)) if x else 100.0 * (not y) for i in range(len(y) - len(x) + 1)), default=0.0)
            assert abs(X._partial(a, b) - plain) < 1e-9, (a, b)
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = rows.select("a", "b", X.ratio("a", "b").alias("r"), X.partial_token_sort_ratio("a", "b").alias("t")).collect()
    assert {(r.a, r.b): r.t for r in got}[("birth date", "date birth")[0], "date of birth"] > 70 and all(r.r == 100 for r in got if r.a == r.b)


def test_overlaps_skip_null_tokens(spark):
    a = spark.createDataFrame([("1",), ("-",), (None,), ("2",)], "x string")
    b = spark.createDataFrame([("1",), ("3",)], "y string")
    assert [tuple(r)[-3:] for r in P.overlaps({"a": a, "b": b}, [(("a", "x"), ("b", "y"))]).collect()] == [(2, 2, 1)]
    assert P.discover_fks({"a": a, "b": b}).isEmpty()


def test_nearest_in_parts(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(M.nearest(v.where("vec_id % 50 = 0"), v, 3)) == key(M.nearest(v.where("vec_id % 50 = 0"), v, 3, 1))


def test_a_stream_that_starts_again_goes_on(spark, tmp_path):
    from graphloom.streaming import notifications as N

    def put(name, rows):
        spark.createDataFrame(rows, N.SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / name))

    read = lambda: {r.filename: r for r in N.run(spark, str(tmp_path / "in/*"), str(tmp_path / "state")).collect()}
    put("1", [("m1", "f", "d", 1, ["a"], ["x"]), ("m2", "f", "d", 2, ["b"], None)])
    assert read()["f"].metadata_id == "m2"
    put("2", [("m4", "f", "e", 4, ["a"], ["y"]), ("k1", "g", "d", 1, None, None)])
    got = read()  # another run over the same state, as after a failure
    assert (got["f"].metadata_id, got["f"].previous_id, got["f"].n_seen, got["f"].tables, got["f"].piis) == ("m4", "m2", 3, ["a", "b"], ["x", "y"]) and got["g"].previous_id is None
    put("3", [("m3", "f", "late", 3, None, None)])
    got = read()
    assert (got["f"].metadata_id, got["f"].domain, got["f"].n_seen) == ("m4", "e", 4)
