import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tabsift.catalog import converting
from tabsift.errors import TabsiftError
from tabsift.operators.infer import apply_inferred
from tabsift.sources import manifest, readers, workbooks, writers
from tabsift.sources.arrays import LINE_END, array_lines
from tabsift.sources.detect import confidences, detect_files, detect_formats
from tabsift.sources.documents import json_to_yaml, yaml_to_json
from tabsift.sources.structure import json_shape, json_summary, shapes


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


# ---- detection -----------------------------------------------------------------------------

WORKBOOK = zipped(xl__workbook_xml="x").replace(b"workbook_xml", b"workbook.xml")
CASES = [
    ("csv", b"name,age,active\nAlice,30,true\nBob,25,false\n", "csv", 1.0),
    ("csv with quotes", b'\xef\xbb\xbfa,b\n"x,y",2\n"l1\nl2",3\n', "csv", 1.0),
    ("semicolons", b"a;b\r\n1;2\r\n3;4\r\n", "csv", 1.0),
    ("tsv", b"id\tname\tage\n1\tMara\t37\n2\tInes\t85\n", "tsv", 0.95),
    ("json table", b'[{"a":1},{"b":2}]', "json", 0.98),
    ("json object", b' {"a":{"b":1}}', "json", 0.95),
    ("json array", b"[1,2]", "json", 0.7),
    ("jsonl", b'{"id":1,"name":"Mara"}\n\n{"id":2,"name":"G"}\n', "jsonl", 1.0),
    ("xml declared", b'<?xml version="1.0"?><a/>', "xml", 0.99),
    ("xml bare", b'<p><q id="1>2"><n>A</n></q><!-- <x> --><br/></p>', "xml", 0.85),
    ("yaml map", b"name: Mara\nage: 41\ntools:\n  - saw\n", "yaml", 0.8),
    ("yaml list", b"# list\n- a\n- b\n", "yaml", 0.8),
    ("yaml marked", b"---\na: 1\n", "yaml", 0.95),
    ("xlsx", WORKBOOK, "xlsx", 0.99),
    ("broken zip", b"PK\x03\x04 junk", "xlsx", 0.4),
    ("other zip", zipped(a="b"), "unknown", 0.1),
    ("empty", b"", "unknown", 0.0),
    ("mixed lines", b"a: b: c\nfree, text\n, , ,", "unknown", 0.0),
]


def test_detected_formats(spark):
    df = spark.createDataFrame([(c[0], c[1]) for c in CASES], "id string, content binary")
    got = {r.id: (r.format, r.confidence) for r in detect_formats(df, "content", ["id"]).collect()}
    assert got == {c[0]: (c[2], c[3]) for c in CASES}


def test_single_confidences(spark):
    texts = [("one object", '{"a":1}'), ("two objects", '{"a":1}\n{"a":2}'), ("bad nesting", "<a><b></a></b>"),
             ("two roots", "<a/><b/>x"), ("stray", "<a>1 < 2</a>"), ("uneven tabs", "a\tb\n" * 40 + "c\n"),
             ("one tab line", "a\tb"), ("comment", "# only")]
    df = spark.createDataFrame(texts, "id string, content string")
    got = {r.id: r for r in confidences(df, "content", ["id"]).collect()}
    assert (got["one object"].jsonl, got["two objects"].json, got["two objects"].jsonl) == (0.45, 0, 1)
    assert {got[k].xml for k in ("bad nesting", "stray")} == {0.05}
    assert (got["uneven tabs"].tsv, got["one tab line"].tsv, got["one tab line"].csv) == (0.6, 0.4, 0)
    assert got["comment"].yaml == 0.1 and got["one object"].yaml == 0.3


def test_long_texts_are_judged_whole(spark):
    good = '{"a": 1}\n' * 20_000
    df = spark.createDataFrame([(1, good), (2, good + "oops\n" * 20_000)], "id long, content string")
    got = {r.id: r.confidence for r in detect_formats(df, "content", ["id"]).collect()}
    assert got == {1: 1.0, 2: 0.5}


def test_rare_line_ends_and_brackets_too_many(spark):
    texts = {
        "a,b\n1,2\n\u2028": ("csv", 1.0), '{"a":1}\n{"a":2}\r': ("jsonl", 1.0), '\n{"a":1}': ("yaml", 0.5),
        '{"a":1}]\n>key: v': ("json", 0.95), '{"a":[\n{}\n,\n{}\n]}': ("json", 0.95), "<a/><b/>": ("xml", 0.85),
        "<a><!-- < --></a>": ("xml", 0.85), "1\n\t\n": ("yaml", 0.5), None: ("unknown", 0.1),
    }
    df = spark.createDataFrame([(k,) for k in texts], "content string")
    got = {r.content: (r.format, r.confidence) for r in detect_formats(df, "content", ["content"]).collect()}
    assert got == texts


def test_corpus_of_one_row_group_is_dealt(spark, tmp_path, monkeypatch):
    """Events of one file that cannot be split: no task judges more than its share of the texts."""
    spark.createDataFrame([(1, "a,b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<p/>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    events = spark.range(1000).select(
        F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(converting, "_EVENTS_PER_TASK", 100, raising=False)
    texts = converting._corpus(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count()
    assert (texts.agg(F.sum("count"), F.max("count")).first()) == (9002, 900)
    assert detect_formats(converting._corpus(spark, str(tmp_path)), "content").count() == 9002


# ---- readers -------------------------------------------------------------------------------

def test_many_small_documents(spark, tmp_path, monkeypatch):
    """One folder holds them all, it is listed once to tell what is known of them, and columns come from
    every document without Spark's own inference, which copies the list of paths for each file."""
    customer = spark.range(1200).select(
        F.col("id").alias("c_custkey"), F.lit("x").alias("c_name"), F.lit(1).alias("c_nationkey"),
        F.lit(0.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    path = converting._files_of_customers(spark, str(tmp_path), converting._json_files)
    files = readers.list_blobs(spark, path).filter("length > 0")
    assert files.select(F.regexp_extract("path", "^(.*)/", 1)).distinct().count() == 1 and files.count() == 12

    listings, inferred = [], []
    listed, schema = manifest.listed, readers._json_schema
    monkeypatch.setattr(manifest, "listed", lambda *a: listings.append(a) or listed(*a))
    monkeypatch.setattr(readers, "_json_schema", lambda *a: inferred.append(a[1]) or schema(*a))
    got = readers.read_each(spark, path)["json"]
    assert len(listings) == 1 and [len(paths) for paths in inferred] == [3]
    assert sorted(r.c_custkey for r in got.collect()) == [i for i in range(1200) if i // 100 % 4 == 0]


def test_schema_of_listed_documents_is_that_of_spark(spark, tmp_path):
    paths = [put(tmp_path, f"{i}.json", text) for i, text in enumerate([
        '\ufeff[\n{"a": 1, "b": {"c": 1}}\n]', '[{"a": 1.5, "b": {"d": []}}, {"e": null}]', '[{"z": "x\\u00e9"},\n]'])]
    got = readers.read_json(spark, paths)
    read = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", readers.CORRUPT)
    assert got.schema == read.json(paths).schema and readers.CORRUPT in got.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, read.json(paths).collect()))


def test_csv(spark, tmp_path):
    path = put(tmp_path, "p.csv", '﻿name,age,active\n"A, ""B""\nC",30,true\nBob,,No\nCarol,42,yes,9\n')
    df = readers.read_csv(spark, path)
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "active": "boolean"}
    assert rows(df, "name") == [('A, "B"\nC', 30, True), ("Bob", None, False), ("Carol", 42, True)]


def test_csv_short_rows_and_repeated_headers(spark, tmp_path):
    path = put(tmp_path, "p.csv", "a,b,a\n1,2,3\n4\n")
    df = readers.read_csv(spark, path)
    assert df.columns == ["a", "b"]
    assert rows(df, F.col("b").desc()) == [(3, 2), (None, None)]


def test_known_types_need_no_second_look(spark, tmp_path):
    path = put(tmp_path, "p.csv", "a,b\n1,x\nz,y\n")
    df = readers.read_csv(spark, path, multi_line=False, schema="a bigint")
    assert df.dtypes == [("a", "bigint"), ("b", "string")] and rows(df, "b") == [(1, "x"), (None, "y")]
    lines = put(tmp_path, "p.jsonl", '{"a":1,"b":"x"}\n')
    assert rows(readers.read_jsonl(spark, lines, "b string, a bigint")) == [("x", 1)]


def test_untyped_cells_stay_text(spark, tmp_path):
    df = readers.read_csv(spark, put(tmp_path, "p.csv", "a\n007\n"), infer=False)
    assert rows(df) == [("007",)]


def test_detected_reading(spark, tmp_path):
    for name, text in [("a.tsv", "id\tname\n1\tMara\n"), ("a.json", '[{"id":1,"name":"Mara"}]'),
                       ("a.jsonl", '{"id":1,"name":"Mara"}\n{"id":2}\n')]:
        df = readers.read_any(spark, put(tmp_path, name, text))
        assert (1, "Mara") in rows(df.select("id", "name"))


def test_jsonl_order_union_and_bad_lines(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"z":1,"a":"x"}\n\n{"m":2.5}\nbad\n')
    df = readers.read_jsonl(spark, path)
    assert df.columns[:2] == ["z", "a"] and "m" in df.columns
    assert df.cache().filter(F.col("_corrupt_record").isNotNull()).count() == 1


def test_xml(spark, tmp_path):
    text = ('<?xml version="1.0"?><people><person id="1"><name> Mara </name><age>41</age></person>'
            '<person id="2"><name/>note</person></people>')
    df = readers.read_xml(spark, put(tmp_path, "a.xml", text), "person")
    assert set(df.dtypes) == {("@id", "string"), ("name", "string"), ("age", "string"), ("#text", "string")}
    got = rows(df.select("@id", "name", "age", "#text"), "@id")
    assert got == [("1", "Mara", "41", None), ("2", None, None, "note")]
    tree = readers.read_xml_tree(spark, put(tmp_path, "b.xml", text))
    assert tree.select(F.variant_get("tree", "$.person[0].name", "string")).first()[0] == "Mara"


def test_yaml(spark, tmp_path):
    path = put(tmp_path, "a.yaml", "name: Mara\nage: 41\ntools: [saw, plane]\nwhen: 2020-01-02\n")
    tree = readers.read_yaml_tree(spark, path).select("tree")
    assert tree.select(F.variant_get("tree", "$.tools[1]", "string")).first()[0] == "plane"
    assert tree.select(F.variant_get("tree", "$.when", "string")).first()[0] == "2020-01-02"
    assert readers.is_tree(readers.read_yaml(spark, path))
    listed = readers.read_yaml(spark, put(tmp_path, "b.yaml", "- {a: 1, b: x}\n- {a: 2}\n"))
    assert rows(listed, "a") == [(1, "x"), (2, None)]


def test_json_documents(spark, tmp_path):
    for name, text, tree in [("a", '{"a":\n [1]}', True), ("b", "[1, 2]", True), ("c", '\n[{"a":1},\n{"b":2}]', False)]:
        df = readers.read_any(spark, put(tmp_path, f"{name}.json", text))
        assert readers.is_tree(df) == tree


def test_attributes_and_text_in_xml(spark, tmp_path):
    df = spark.createDataFrame([("1", "note", "x")], "`@id` string, `#text` string, k string")
    writers.write_xml(df.coalesce(1), str(tmp_path / "o"), "item", "items")
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.xml"))
    assert '<item id="1">' in text and "note" in text and text.startswith("<?xml")
    assert rows(readers.read_xml(spark, str(tmp_path / "o"), "item").select("@id", "#text", "k")) == \
        [("1", "note", "x")]


def test_yaml_texts(spark):
    df = spark.createDataFrame([("",), ("a: [",), ("x: .inf",), (None,)], "t string")
    assert [r[0] for r in df.select(yaml_to_json(F.col("t"))).collect()] == \
        ["{}", None, '{"x": "inf"}', None]
    text = spark.createDataFrame([('{"z":1,"a":["é"]}',)], "t string").select(json_to_yaml(F.col("t")))
    assert text.first()[0] == "z: 1\na:\n- é"


def test_files_with_only_a_header_do_not_decide(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y\n")
    put(tmp_path, "b.csv", "x,y\n" + "1,2\n" * 5000)
    assert readers.detect_path(spark, str(tmp_path)) == "csv"


@pytest.mark.parametrize("text,fmt", [
    ("[" + ",\n".join('{"a":1}' for _ in range(3000)) + "]", "json"),
    ("<r>" + "<i>1</i>\n" * 3000 + "</r>", "xml"), ('{"a":1}\n' * 3000, "jsonl"),
])
def test_long_files_are_recognised(spark, tmp_path, text, fmt):
    assert readers.detect_path(spark, put(tmp_path, "f", text)) == fmt


def test_a_mixed_folder_is_refused_and_read_apart(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y\n" + "1,2\n" * 1500)
    put(tmp_path, "b.jsonl", '{"x":3,"y":4}\n' * 10)
    with pytest.raises(TabsiftError) as e:
        readers.read_any(spark, str(tmp_path))
    assert e.value.code == "MIXED_FORMATS"
    parts = readers.read_each(spark, str(tmp_path))
    assert {k: v.count() for k, v in parts.items()} == {"csv": 1500, "jsonl": 10}


@pytest.mark.parametrize("line", ['{"x":3,"y":4}', '[{"x":3,"y":4}]', "free text", "p,q", "x;y", "3,4"])
def test_one_line_that_is_no_header_is_refused(spark, tmp_path, line):
    put(tmp_path, "a.csv", "x,y\n" + "1,2\n" * 10)
    put(tmp_path, "b", line + "\n")
    with pytest.raises(TabsiftError) as e:
        readers.read_any(spark, str(tmp_path))
    assert e.value.code == "MIXED_FORMATS"


def test_one_line_that_goes_with_the_others_is_read(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"x":1}\n' * 10)
    put(tmp_path, "b.jsonl", '{"x":2}\n')
    assert readers.read_any(spark, str(tmp_path)).count() == 11


def test_files_that_cannot_be_read_are_listed(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y\n" + "1,2\n" * 10)
    put(tmp_path, "b.json", '{"x":3}\n')
    put(tmp_path, "c", "%%% @@@\n")
    parts = readers.read_each(spark, str(tmp_path))
    assert {k: v.count() for k, v in parts.items()} == {"csv": 10, "json": 1, "unread": 1}
    row = parts["unread"].first()
    assert row["path"].endswith("/c") and row["format"] == "unknown"


def test_the_end_of_a_file_counts_as_much_as_its_start(spark, tmp_path):
    path = put(tmp_path, "f", '{"a":1}\n' * 2000 + "free text here, and more\n" * 4000)
    assert detect_files(spark, path).first()["format"] != "jsonl"


@pytest.mark.parametrize("sep", [",", ";", "|"])
def test_delimiters_are_found(spark, tmp_path, sep):
    path = put(tmp_path, "a", f"a{sep}b\n" + f"1{sep}x\n2{sep}y\n" * 3)
    assert rows(readers.read_csv(spark, path, sep="auto"), "a")[0] == (1, "x")
    assert readers.read_any(spark, path).columns == ["a", "b"]


def test_headers_in_two_orders_are_matched_by_name(spark, tmp_path):
    put(tmp_path, "a.csv", "a,b\n1,x\n")
    put(tmp_path, "b.csv", "b,a\ny,2\n")
    assert rows(readers.read_csv(spark, str(tmp_path)).select("a", "b"), "a") == [(1, "x"), (2, "y")]


def test_missing_path(spark, tmp_path):
    with pytest.raises(TabsiftError) as e:
        readers.read_any(spark, str(tmp_path / "none"))
    assert e.value.code == "NOT_FOUND"


def test_unknown_formats(spark, tmp_path, people):
    path = put(tmp_path, "x.bin", "a: b: c\nfree, text\n")
    with pytest.raises(TabsiftError) as e:
        readers.read_any(spark, path)
    assert e.value.code == "UNKNOWN_FORMAT"
    with pytest.raises(TabsiftError) as e:
        writers.write_any(people, str(tmp_path / "o"), "pdf")
    assert e.value.code == "UNKNOWN_OUTPUT_FORMAT"


def test_listing(spark, tmp_path):
    (tmp_path / "u1").mkdir()
    put(tmp_path / "u1", "a.csv", "12345")
    listed = readers.list_blobs(spark, str(tmp_path)).collect()
    assert [(r.path.endswith("u1/a.csv"), r.length) for r in listed] == [(True, 5)]


# ---- round trips -----------------------------------------------------------------------------

@pytest.fixture
def odd(spark):
    return spark.createDataFrame(
        [(1, 'quote " comma , tab\t', 1.5, True), (2, "two\nlines", None, False),
         (3, None, -2.0, None), (4, "ünïcödé <&>", 0.25, True)],
        "id long, text string, num double, flag boolean",
    )


@pytest.mark.parametrize("fmt,options", [
    ("csv", {}), ("tsv", {}), ("jsonl", {}), ("yaml", {}), ("xml", {"row_tag": "row"}),
])
def test_round_trip(spark, tmp_path, odd, fmt, options):
    path = str(tmp_path / fmt)
    writers.write_any(odd, path, fmt)
    back = readers.read_any(spark, path, fmt, **options)
    if fmt == "xml":
        back = apply_inferred(back)
    got = back.select("id", "text", F.col("num").cast("double"), "flag")
    # Markup readers strip the text of an element.
    want = odd.withColumn("text", F.rtrim("text", F.lit("\t"))) if fmt == "xml" else odd
    assert rows(got, "id") == rows(want, "id")


def test_jsonl_writes_nulls_in_column_order(tmp_path, odd):
    path = tmp_path / "o"
    writers.write_jsonl(odd.filter("id = 3").coalesce(1), str(path))
    text = "".join(p.read_text() for p in path.glob("*.json"))
    assert text == '{"id":3,"text":null,"num":-2.0,"flag":null}\n'


def test_nested_cells_in_delimited_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "id long, xs array<int>")
    writers.write_csv(df, str(tmp_path / "o"))
    assert rows(readers.read_csv(spark, str(tmp_path / "o"))) == [(1, "[1,2]")]


# ---- workbooks -------------------------------------------------------------------------------

def two_sheets():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="people" sheetId="1" '
                   'r:id="rId1"/><sheet name="orders" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><t>na</t><t>me</t></si>"
                   "<si><t>Mara</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
                   "</cellXfs></styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr">'
                   '<is><t>born</t></is></c></row>'
                   '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c>'
                   '<c r="D2" s="1"><v>44197.5</v></c></row>'
                   '<row r="3"><c r="A3"><v>2</v></c><c r="B3" t="str"><v>Ines</v></c></row>'
                   '</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row><c t="inlineStr"><is>'
                   '<t>order_id</t></is></c><c t="inlineStr"><is><t>total</t></is></c></row>'
                   '<row><c><v>1001</v></c><c><v>25.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook_sheets(spark, tmp_path):
    path = put(tmp_path, "two.xlsx", two_sheets())
    books = readers.read_blobs(spark, path)
    assert [r.sheet for r in workbooks.list_sheets(books).orderBy("sheet_index").collect()] == \
        ["people", "orders"]
    first = readers.read_any(spark, path)
    assert first.columns == ["id", "name", "col_2", "born"]
    assert rows(first, "id") == [(1, "Mara", True, "2021-01-01 12:00:00"), (2, "Ines", None, None)]
    second = readers.read_xlsx(spark, path, "orders")
    assert second.dtypes == [("order_id", "bigint"), ("total", "double")] and rows(second) == [(1001, 25.5)]
    both = workbooks.workbook_rows(books, all_sheets=True)
    assert both.groupBy("sheet").count().count() == 2


def test_made_workbooks(spark, tmp_path, odd):
    books = workbooks.make_workbooks(odd.coalesce(1), rows_per_book=3).collect()
    assert [b["rows"] for b in books] == [3, 1]
    for b in books:
        put(tmp_path, b.path, bytes(b.content))
    back = readers.read_xlsx(spark, str(tmp_path))
    assert rows(back.select(*odd.columns), "id") == rows(odd, "id")
    assert detect_formats(spark.createDataFrame(books), "content").first()["format"] == "xlsx"


def test_unread_documents_say_why(spark, tmp_path):
    for name, text in (("a.json", '{"a":1}'), ("b.json", '{"a":'), ("c.json", " ")):
        put(tmp_path, name, text)
    got = {r.path[-6:]: (r.tree is None, r.reason) for r in readers.read_json_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.json": (False, None), "b.json": (True, "malformed"), "c.json": (True, "empty")}
    put(tmp_path, "x.xml", "<!DOCTYPE r [<!ENTITY e 'v'>]><r>&e;</r>")
    assert readers.read_xml_tree(spark, str(tmp_path / "x.xml")).first().reason == "malformed"


# ---- what a file holds, and what is known of it ------------------------------------------------

@pytest.mark.parametrize("text", [
    "[section]\nkey=value\nother=1\n[end]\n", "{ this is\nplain text }\n", "[1,\n2\n3]\n", '[{"a":1}\n{"a":2}]\n',
    '{"a":1,\n"b"}\n', '{"a":[1,\n2}\n]', "[1,\n2,\n]\n",
])
def test_brackets_alone_are_no_json(spark, tmp_path, text):
    path = put(tmp_path, "f", text)
    assert detect_files(spark, path).first()["format"] == "unknown"
    with pytest.raises(TabsiftError):
        readers.read_any(spark, path)


def test_tags_must_nest(spark, tmp_path):
    for text in ("<a>\n<b>\n", "<a>\n</b>\n</a>\n", "<a/>\n<b/>\n", "<a>\n</a>\nx <b/>\n"):
        assert detect_files(spark, put(tmp_path, "f", text)).first()["format"] != "xml"
    good = "<a x='1>'\n y=\"<!--\">\n<!-- <b> -->\n<![CDATA[</a>]]>\n</a>\n"
    assert detect_files(spark, put(tmp_path, "f", good.replace("<!--\"", "z\""))).first()["format"] == "xml"


def test_a_broken_document_is_no_silent_null(spark, tmp_path):
    for name, fmt, text in (("a", "json", '{"a":\n'), ("b", "json", '{"a":1} x'), ("c", "xml", "<a>\n<b>")):
        path = put(tmp_path, name, text)
        with pytest.raises(Exception, match="has no tree: malformed"):
            readers.read_any(spark, path, fmt).collect()
    assert readers.read_json(spark, put(tmp_path, "d", " \n")).count() == 0


def test_structure_across_splits(spark, tmp_path):
    """Files cut into many splits are judged as a whole."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows_ = ",\n".join('{"k": %d, "s": "a, [b] \\"c\\" {"}' % i for i in range(60))
        cases = {"table": f"[\n{rows_}\n]\n", "none": f"[\n{rows_}\n}}\n", "object": '{"x": [\n' + rows_ + "\n]}\n",
                 "list": f"[\n1,\n{rows_}\n]\n"}
        for shape, text in cases.items():
            assert shapes(spark, put(tmp_path, f"{shape}.json", text), "json").first()["shape"] == shape
        items = "".join(f"<i\n n='{i}>'><!-- <x>\n -->text\n<![CDATA[ </r>\n ]]></i\n>\n" for i in range(40))
        for shape, text in (("element", f"<r>\n{items}</r>\n"), ("none", f"<r>\n{items}<i>\n</r>\n")):
            path = put(tmp_path, f"{shape}.xml", text)
            assert spark.read.text(path).rdd.getNumPartitions() > 4
            assert shapes(spark, path, "xml").first()["shape"] == shape
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _json_parts(text, cuts):
    lines, out, at = text.split("\n"), "", 0
    parts = []
    for cut in [*sorted(cuts), len(lines)]:
        parts.append(json_summary("\n".join(lines[at:cut]) + "\n"))
        at = cut
    return parts


def test_json_summaries_against_a_parser():
    r = random.Random(4)

    def value(depth):
        k = r.random()
        if depth > 3 or k < 0.3:
            return r.choice([1, -2.5e3, "a,b", '{]"\\x', True, None, ""])
        if k < 0.6:
            return [value(depth + 1) for _ in range(r.randint(0, 4))]
        return {r.choice("abc:d"): value(depth + 1) for _ in range(r.randint(0, 4))}

    for _ in range(3000):
        text = json.dumps(value(0), indent=r.choice([None, 1]))
        if r.random() < 0.6:
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice([",", "]", "}", "[", "{", "\n", '"', ":", "1", " x", ""]) + text[at + r.randint(0, 2):]
        if text.lstrip()[:1] not in ("{", "["):
            continue
        try:
            tree = json.loads(text, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            want = "none"
        else:
            table = isinstance(tree, list) and all(isinstance(x, dict) for x in tree)
            want = "object" if isinstance(tree, dict) else "table" if table else "list"
        lines = text.count("\n") + 1
        assert json_shape(_json_parts(text, [r.randrange(lines + 1) for _ in range(r.randint(0, 3))])) == want


def test_known_files_are_not_read_again(spark, tmp_path, monkeypatch):
    put(tmp_path, "a.csv", "x,y\n1,a\n")
    put(tmp_path, "blank.csv", "\n")
    read = []
    judge = manifest.detect_files
    monkeypatch.setattr(manifest, "detect_files", lambda s, p: read.append(p) or judge(s, p))
    facts = manifest.column_facts
    monkeypatch.setattr(manifest, "column_facts", lambda *a: read.append("types") or facts(*a))
    first = readers.read_any(spark, str(tmp_path))
    assert rows(first, "x") == [(1, "a")] and read == [str(tmp_path), "types"]
    read.clear()
    assert readers.read_any(spark, str(tmp_path)).dtypes == first.dtypes and read == []
    # A new file is judged alone, and its cells change the type.
    put(tmp_path, "b.csv", "x,y\n2.5,b\n3,c\n")
    assert rows(readers.read_any(spark, str(tmp_path)), "y") == [(1.0, "a"), (2.5, "b"), (3.0, "c")]
    assert len(read) == 2 and len(read[0]) == 1 and read[0][0].endswith("b.csv")
    # So is one that has changed.
    read.clear()
    put(tmp_path, "b.csv", "x,y\n2.5,b\n3,c\nz,d\n")
    assert readers.read_any(spark, str(tmp_path)).dtypes[0] == ("x", "string") and len(read[0]) == 1


def test_headers_of_many_files_make_one_scan(spark, tmp_path):
    orders = (["a", "b", "c"], ["c", "a", "b"], ["b", "a"])
    for i in range(60):
        names = orders[i % 3]
        put(tmp_path, f"f{i}.csv", ",".join(names) + "\n" + ",".join(str(i) if n == "a" else f"{n}{i}" for n in names) + "\n")
    df = readers.read_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string"}
    got = {r["a"]: (r["b"], r["c"]) for r in df.collect()}
    assert got == {i: (f"b{i}", f"c{i}" if i % 3 < 2 else None) for i in range(60)}
    # One scan: the number of orders is not the number of branches.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FileScan csv") == 1


def test_files_without_common_columns_are_refused(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"f{i}.csv", f"{i},a{i}\n{i + 100},b{i}\n")
    with pytest.raises(TabsiftError) as e:
        readers.read_csv(spark, str(tmp_path))
    assert e.value.code == "MIXED_FORMATS" and "share no column" in e.value.message


# ---- delimited files in splits -----------------------------------------------------------------

@pytest.fixture
def small_splits(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _odd_cell(rnd, sep):
    text = "".join(rnd.choice(["a", "b", sep, "\n", '"', "é", " ", "\n\n"]) for _ in range(rnd.randint(0, 12)))
    if rnd.random() < 0.5:
        return '"' + text.replace('"', '""') + '"' + rnd.choice(["", "", "", " ", "z"])
    bare = "".join(c for c in text if c not in sep + '\n"')
    return rnd.choice(["", "", "k"]) and f'k{bare}' + rnd.choice(['"', '5" x', '""']) or bare


@pytest.mark.parametrize("size,sep,end", [(64, ",", "\n"), (300, ";", "\r\n"), (150, "\t", "\n")])
def test_wrapped_cells_in_splits(spark, tmp_path, small_splits, size, sep, end):
    rnd = random.Random(size)
    for name in "ab":
        lines = [sep.join(("x", "y", "z"))] + [
            sep.join(_odd_cell(rnd, sep) for _ in range(rnd.choice([2, 3, 3, 3, 4]))) for _ in range(60)]
        (tmp_path / f"{name}.csv").write_text(end.join(lines) + rnd.choice(["", end]), newline="")
    read = dict(sep=sep, multi_line=True, infer=False, one_header=True)
    whole = [tuple(r) for r in readers.read_csv(spark, str(tmp_path), in_splits=False, **read).collect()]
    small_splits(size)
    parts = readers.read_csv(spark, str(tmp_path), **read)
    assert parts.columns == ["x", "y", "z"]
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(whole, key=str)
    assert parts.select(F.spark_partition_id()).distinct().count() > 2


def test_wrapped_records_over_many_splits(spark, tmp_path, small_splits):
    long = "line, one\n" * 100
    path = put(tmp_path, "a.csv", f'﻿"a\nb",c\n"{long}",1\n\n2,"{long}"\n3,"open {long[:-1]}')
    small_splits(150)
    df = readers.read_csv(spark, path, multi_line=True, infer=False)
    assert df.columns == ["a\nb", "c"]
    whole = readers.read_csv(spark, path, multi_line=True, infer=False, in_splits=False)
    assert rows(df, "c") == rows(whole, "c")
    assert (long, "1") in rows(df) and df.count() == 3


def test_wrapped_files_without_rows_and_other_line_ends(spark, tmp_path):
    def read(name, text):
        whole, parts = (rows(readers.read_csv(spark, put(tmp_path, name, text), multi_line=True, infer=False, in_splits=s))
                        for s in (False, True))
        assert parts == whole
        return parts

    assert read("head.csv", "a,b\n") == [] and read("quoted.csv", '"a\n",b') == []
    # Lines that end in a bare CR are read by one task.
    assert read("mac.csv", 'a,b\r1,"x\ry"\r') == [("1", "x\ny")]
    assert read("one.csv", 'a,a\n1,"x\r\ny"\r\n') == [("x\r\ny",)]


def test_wrapped_files_in_two_orders(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n' * 1 + '2,"p\n""q"""\n' * 20)
    (tmp_path / "b.csv").write_text('b,c,a\n"z\n\n,",7,3\n')
    small_splits(64)
    df = readers.read_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "bigint"}
    assert sorted(df.select("a", "b", "c").distinct().collect()) == [
        (1, "x\ny", None), (2, 'p\n"q"', None), (3, "z\n\n,", 7)]
    assert df.count() == 22


def test_splits_that_changed_are_refused(spark, tmp_path, small_splits):
    path = put(tmp_path, "a.csv", "a,b\n" + '1,"x\ny"\n' * 100)
    small_splits(128)
    df = readers.read_csv(spark, path, multi_line=True, infer=False)
    small_splits(70)
    with pytest.raises(Exception, match="read it again"):
        df.select("*").collect()


def _object(rnd):
    return {"id": rnd.randint(0, 99), "t": rnd.choice(["a,", "[x", "}", 'q"\\', "é", ""]),
            "n": [rnd.randint(0, 9) for _ in range(rnd.randint(0, 3))], "o": {"k": [{"z": 1}, {"z": [2]}]}}


def _array_texts(rnd):
    """Indented, an element a line, commas first, and two long lines."""
    a, b, c, d = ([_object(rnd) for _ in range(40)] for _ in range(4))
    return [json.dumps(a, indent=1), "[\n" + ",\n".join(map(json.dumps, b)) + "\n]\n",
            "\ufeff[ " + "\n ,".join(json.dumps(x, indent=2) for x in c) + "]",
            json.dumps(d[:20])[:-1] + ",\r\n" + json.dumps(d[20:])[1:]]


@pytest.mark.parametrize("size", [300, 900])
def test_arrays_in_splits(spark, tmp_path, small_splits, size):
    for i, text in enumerate(_array_texts(random.Random(size))):
        put(tmp_path, f"{i}.json", text)
    whole = readers.read_json(spark, str(tmp_path), in_splits=False)
    want = sorted(map(str, whole.collect()))
    small_splits(size)
    parts = readers.read_json(spark, str(tmp_path))
    assert parts.schema == whole.schema and len(want) == 160
    assert sorted(map(str, parts.collect())) == want
    typed = readers.read_json(spark, str(tmp_path), "id long, t string")
    assert sorted(map(tuple, typed.collect())) == sorted(map(tuple, whole.select("id", "t").collect()))


def test_elements_are_cut_at_every_line_that_ends_one(spark, tmp_path, small_splits):
    put(tmp_path, "a.json", "[\n" + ",\n".join(json.dumps({"id": i}) for i in range(100)) + "\n]")
    small_splits(50)
    lines = spark.read.option("lineSep", LINE_END).text(array_lines(spark, str(tmp_path)))
    # None of the lines holds more than what one edge brings together.
    assert lines.agg(F.max(F.length("value"))).first()[0] < 40 and lines.count() > 60


def test_only_lists_of_objects_are_read_in_splits(spark, tmp_path):
    for name, text in [("a", "[1, 2]"), ("b", '{"a": 1}'), ("c", '[{"a": 1}')]:
        assert array_lines(spark, put(tmp_path, f"{name}.json", text)) is None
    tree = readers.read_json(spark, str(tmp_path / "a.json"), in_splits=True)
    assert readers.is_tree(tree) and tree.count() == 1
    empty = put(tmp_path, "e.json", "[\n]\n")
    got = readers.read_json(spark, empty, in_splits=True)
    assert got.collect() == readers.read_json(spark, empty, in_splits=False).collect()


def test_bare_headers_and_single_objects_go_with_the_files_beside_them(spark, tmp_path):
    path = str(tmp_path / "mixed")
    for name, lines in (
        ("a.csv", ["id,name", "1,x", "2,y"]), ("b.csv", ["id,name"]), ("a.jsonl", ['{"id": 3}', '{"id": 4}']),
        ("b.jsonl", ['{"id": 5}']), ("a.tsv", ["id\tname", "6\tz"]), ("b.tsv", ["id\tname"]),
    ):
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{path}/{name}")
    parts = readers.read_each(spark, path)
    assert {fmt: sorted(r["id"] for r in df.collect()) for fmt, df in parts.items()} == {
        "csv": [1, 2], "jsonl": [3, 4, 5], "tsv": [6]}


def test_a_long_yaml_list_is_loaded_in_parts(monkeypatch):
    import yaml

    from tabsift.sources import documents

    sizes = []
    load = yaml.load

    def seen(text, Loader):
        sizes.append(text.count("\n- ") + 1)
        return load(text, Loader=Loader)

    monkeypatch.setattr(yaml, "load", seen)
    monkeypatch.setattr(documents, "YAML_ENTRIES", 10)

    def same(text):
        sizes.clear()
        whole = load(text, Loader=yaml.SafeLoader)
        assert documents.yaml_document(text, yaml.SafeLoader) == documents._dumped({} if whole is None else whole)

    same("\n".join(f"- a: {i}\n  b: 'x\n\n    - y'" for i in range(95)))
    assert max(sizes) == 10 and len(sizes) == 10
    # A quoted text over an edge, an alias of another part, entries that are no maps, nothing at all.
    same("\n".join(["- 1"] * 9) + '\n- "a\n- b"\n' + "\n".join(["- 2"] * 9))
    same("- &x 1\n" + "- 2\n" * 20 + "- *x\n")
    same("- null\n" * 25 + "-\n- [1, 2]\n")
    same("")
    for broken in ("- 1\n" * 12 + "...\n- 2\n", "- 1\n" * 12 + "- [\n"):
        with pytest.raises(yaml.YAMLError):
            documents.yaml_document(broken, yaml.SafeLoader)


def test_documents_in_splits_are_written_by_more_than_one_task(spark, tmp_path):
    from tabsift.catalog import QUERIES

    rows = spark.range(40).selectExpr("id AS doc_id", "concat('a,\n\"', repeat('x', 3000)) AS text", "'s' AS source")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        found = QUERIES["csv_documents_in_splits"](spark, str(tmp_path))
        assert len({f for f in found.inputFiles() if f.endswith('.csv')}) > 1
        assert sorted(found.collect()) == sorted(rows.select("doc_id", "text", "source").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
