import zipfile

from pyspark.sql import functions as F

from graphloom.operators import rules as R
from graphloom.sources import excel, jdbc, mappings, tabular


def workbook(path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="b" sheetId="2" r:id="rId9"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>o</t></r><r><t>k</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>size</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>1.5</v></c><c r="D2" t="e"><v>#N/A</v></c></row><row><c r="A3"><v>7</v></c></row></sheetData></worksheet>')


def test_excel_reads_the_first_listed_sheet(spark, tmp_path):
    workbook(tmp_path / "t.xlsx")
    t = excel.table(excel.read(spark, str(tmp_path)), "t.xlsx")
    assert t.columns == ["name", "Unknown_Header_1", "size", "Unknown_Header_2"]
    assert sorted(map(tuple, t.collect())) == [("7", "", "", ""), ("ok", "true", "1.5", "")]


def test_jdbc_reads_in_ranges_and_gives_the_catalog(spark):
    url = "jdbc:derby:memory:sources;create=true"
    spark.range(1, 101).select(F.col("id").cast("int").alias("ID"), (F.col("id") % 7).cast("int").alias("K")).write.jdbc(url, "T", mode="overwrite")
    t = jdbc.table(spark, url, "T", key="ID", partitions=4)
    assert t.rdd.getNumPartitions() == 4 and t.count() == 100 and t.agg(F.sum("ID")).first()[0] == 5050
    assert jdbc.query(spark, url, "SELECT K, COUNT(*) AS N FROM T GROUP BY K").where("K = 0").first().N == 14
    own = {"columns": "SELECT t.tablename AS \"table\", c.columnname AS \"column\" FROM sys.systables t JOIN sys.syscolumns c ON c.referenceid = t.tableid WHERE t.tablename = '{schema}'"}
    own |= dict.fromkeys(("keys", "references"), "")
    columns = jdbc.query(spark, url, own["columns"].format(schema="T"))
    keys = spark.createDataFrame([("T", "ID")], "table string, column string")
    references = spark.createDataFrame([("T", "K", "U", "ID")], "table string, column string, fk_table string, fk_column string")
    got = jdbc.catalog(columns, keys, references)
    assert sorted(map(tuple, got.collect()), key=str) == [("T", "ID", 1, None, None), ("T", "K", 0, "U", "ID")]
    assert R.classes(got).first().rule == 2


def test_mapping_tables_and_alignments(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("SrcEntity\tTgtEntity\tScore\na\tNULL\t0.9\nb\tn/a\t0.4\nc\tx\tbad\n")
    assert [tuple(r) for r in mappings.read_mappings(spark, str(tmp_path / "m.tsv"), 0.5).collect()] == [("a", "NULL", 0.9)]
    assert mappings.read_mappings(spark, str(tmp_path / "m.tsv"), reference=True).count() == 3
    cell = lambda a, b, r: f'<map><Cell><entity1 rdf:resource="{a}"/><entity2 rdf:resource="{b}"/><relation>{r}</relation><measure>0.5</measure></Cell></map>'
    (tmp_path / "a.rdf").write_text(f'<rdf:RDF xmlns:rdf="r">{cell("u", "v", "=")}{cell("u", "w", "?")}{cell("x", "y", "&lt;")}</rdf:RDF>')
    reference, ignored = mappings.read_alignment(spark, str(tmp_path / "a.rdf"))
    assert sorted(map(tuple, reference.collect())) == [("u", "v", "=", 0.5), ("x", "y", "<", 0.5)]
    assert [r.tgt for r in ignored.collect()] == ["w"]


def test_delimited_rows_equal_to_the_header_stay(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a;b;a\n1;"x\na;b;a\n2;y;z;w\n')
    t = tabular.read(spark, str(tmp_path / "t.csv"))
    assert t.columns == ["a", "b", "a_3", "Unknown_Header_1"]
    assert sorted(map(tuple, t.collect())) == [("1", '"x', "", ""), ("2", "y", "z", "w"), ("a", "b", "a", "")]


def test_json_lines_lose_mark_and_blanks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'\xef\xbb\xbf{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.value for r in mappings.read_json_lines(spark, str(tmp_path / "x.jsonl")).collect()) == ['{"a": 1}', '{"a": 2}']
