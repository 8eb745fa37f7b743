"""Queries: format detection, round trips through every format, workbooks, jobs that convert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsift.catalog.base import query, table
from tabsift.errors import MIXED_FORMATS, TabsiftError
from tabsift.operators.filters import apply_filter
from tabsift.operators.infer import apply_inferred
from tabsift.operators.paths import path_profile
from tabsift.operators.trees import tree_to_rows
from tabsift.plans.flow import convert, preview_path, run_job
from tabsift.session import scratch_path, split_bytes
from tabsift.sources import readers, workbooks, writers
from tabsift.sources.detect import beside_others, detect_files, detect_formats
from tabsift.sources.documents import json_to_yaml, xml_to_json, yaml_to_json

_CUSTOMER = """SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment
FROM customer"""
_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _round_trip(fmt, **options):
    def run(spark, sf_dir):
        path = scratch_path(spark, fmt)
        writers.write_any(table(spark, sf_dir, "customer"), path, fmt)
        return readers.read_any(spark, path, fmt, **options).select(*_COLUMNS)

    return run


for _fmt in ("csv", "tsv", "jsonl", "yaml"):
    query(_CUSTOMER, name=f"roundtrip_{_fmt}")(_round_trip(_fmt))


@query(_CUSTOMER)
def roundtrip_xml(spark, sf_dir):
    return apply_inferred(_round_trip("xml", row_tag="row")(spark, sf_dir))


@query(_CUSTOMER)
def roundtrip_detected(spark, sf_dir):
    """The reader finds the format itself."""
    path = scratch_path(spark, "any")
    writers.write_any(table(spark, sf_dir, "customer"), path, "csv")
    return readers.read_any(spark, path).select(*_COLUMNS)


@query(_CUSTOMER)
def roundtrip_semicolons(spark, sf_dir):
    """Semicolon-separated Latin-1 text; the reader finds the delimiter."""
    path = scratch_path(spark, "semicolons")
    rows = table(spark, sf_dir, "customer").select(*_COLUMNS).withColumn("note", F.lit("año; été"))
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    back = readers.read_csv(spark, path, sep="auto", encoding="ISO-8859-1")
    return back.filter(F.col("note") == "año; été").select(*_COLUMNS)


@query(_CUSTOMER)
def roundtrip_two_headers(spark, sf_dir):
    """Files of one folder that list their columns in two orders are read by name."""
    path = scratch_path(spark, "headers")
    rows = table(spark, sf_dir, "customer").select(*_COLUMNS)
    odd = F.col("c_custkey") % 2 == 1
    writers.write_csv(rows.filter(odd), path)
    writers.write_csv(rows.filter(~odd).select(*_COLUMNS[::-1]), path, mode="append")
    return readers.read_csv(spark, path).select(*_COLUMNS)


def _mixed_folder(spark, sf_dir) -> str:
    """The customers of each market segment in a format of their own, below one folder."""
    path = scratch_path(spark, "mixed")
    rows = table(spark, sf_dir, "customer").select(*_COLUMNS)
    for segment, fmt in (("BUILDING", "csv"), ("AUTOMOBILE", "jsonl"), ("MACHINERY", "tsv")):
        writers.write_any(rows.filter(F.col("c_mktsegment") == segment), f"{path}/{fmt}", fmt)
    return path


@query("""SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'csv' WHEN 'AUTOMOBILE' THEN 'jsonl' ELSE 'tsv' END
  AS format, count(*) + CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 0 ELSE 1 END AS lines
FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') GROUP BY c_mktsegment""")
def mixed_folder_formats(spark, sf_dir):
    """Each file is judged for itself, by all of its lines."""
    files = beside_others(detect_files(spark, _mixed_folder(spark, sf_dir)))
    by_format = files.groupBy("format").agg(F.sum("lines").alias("lines"), F.count("*").alias("n"))
    headers = F.when(F.col("format") == "jsonl", 0).otherwise(F.col("n") - 1)
    return by_format.select("format", (F.col("lines") - headers).alias("lines"))


@query(_CUSTOMER + " WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')")
def mixed_folder_rows(spark, sf_dir):
    parts = readers.read_each(spark, _mixed_folder(spark, sf_dir))
    rows = [p.select(*_COLUMNS) for p in parts.values()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""SELECT 'csv' AS format, count(*) AS rows FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'json', 1 UNION ALL SELECT 'unread', 1""")
def mixed_folder_leftovers(spark, sf_dir):
    """A document of one line and a file of no known format beside CSV files: refused as one table,
    and each accounted for when read apart."""
    path = scratch_path(spark, "leftovers")
    rows = table(spark, sf_dir, "customer").select(*_COLUMNS)
    writers.write_csv(rows.filter(F.col("c_mktsegment") == "BUILDING"), f"{path}/csv")
    for name, line in (("json", '{"c_custkey": 1, "c_name": "one"}'), ("text", "%%% @@@")):
        spark.createDataFrame([(line,)], "value string").write.text(f"{path}/{name}")
    try:
        readers.read_any(spark, path)
    except TabsiftError as e:
        if e.code != MIXED_FORMATS:
            raise
    else:
        raise AssertionError("a mixed folder was read as one table")
    counts = [df.agg(F.lit(fmt).alias("format"), F.count("*").alias("rows"))
              for fmt, df in readers.read_each(spark, path).items()]
    return reduce(DataFrame.unionAll, counts)


def _files_of_customers(spark, sf_dir, lines) -> str:
    """A file for every 100 customers; ``lines`` turns the rows' texts and the file's kind into one text."""
    path = scratch_path(spark, "documents")
    rows = table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 100).alias("file"), F.struct(*_COLUMNS).alias("row"))
    files = rows.groupBy("file").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    files = files.withColumn("kind", F.col("file") % 4)
    # One row is one file. All lie in one folder: a folder for each would be listed apart by every reader.
    files.select(lines(F.col("rows"), F.col("kind")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _json_files(rows, kind):
    """Lists of objects; with a comma lost, with the last bracket wrong, and settings in brackets."""
    texts = F.transform(rows, lambda r: F.to_json(r))
    settings = F.transform(rows, lambda r: F.concat(r["c_custkey"].cast("string"), F.lit("="), r["c_name"]))
    return (
        F.when(kind == 0, F.concat(F.lit("[\n"), F.array_join(texts, ",\n"), F.lit("\n]")))
        .when(kind == 1, F.concat(F.lit("[\n"), F.array_join(texts, "\n"), F.lit("\n]")))
        .when(kind == 2, F.concat(F.lit("[\n"), F.array_join(texts, ",\n"), F.lit("\n}")))
        .otherwise(F.concat(F.lit("[customers]\n"), F.array_join(settings, "\n"), F.lit("\n[end]")))
    )


def _xml_files(rows, kind):
    """One root; with its closer lost, with another name in it, and with two roots."""
    items = F.array_join(F.transform(rows, lambda r: F.concat(
        F.lit("<c\n id='"), r["c_custkey"].cast("string"), F.lit("'><!-- </c> -->"), r["c_name"], F.lit("</c>"))), "\n")
    end = F.when(kind == 0, "</all>").when(kind == 1, "<all>").when(kind == 2, "</other>").otherwise("</all>\n<all>\n</all>")
    return F.concat(F.lit("<all>\n"), items, F.lit("\n"), end)


_FILES = """SELECT CASE c_custkey // 100 % 4 WHEN 0 THEN '{0}' ELSE '{1}' END AS format,
       count(DISTINCT c_custkey // 100) AS files FROM customer GROUP BY 1"""


@query(_FILES.format("json", "unknown"))
def detect_json_files(spark, sf_dir):
    """Files that begin and end like JSON, of which only those that parse are."""
    files = detect_files(spark, _files_of_customers(spark, sf_dir, _json_files))
    return files.groupBy("format").agg(F.count("*").alias("files"))


@query(_FILES.format("xml", "other"))
def detect_xml_files(spark, sf_dir):
    """Files between tags, of which only those whose tags nest around one root are XML."""
    files = detect_files(spark, _files_of_customers(spark, sf_dir, _xml_files))
    kind = F.when(F.col("format") == "xml", "xml").otherwise("other").alias("format")
    return files.groupBy(kind).agg(F.count("*").alias("files"))


@query(f"{_CUSTOMER} WHERE c_custkey // 100 % 4 = 0")
def json_files_rows(spark, sf_dir):
    """A folder of broken and whole documents, read apart: the whole ones lose nothing."""
    path = _files_of_customers(spark, sf_dir, _json_files)
    return readers.read_each(spark, path)["json"].select(*_COLUMNS)


@query(_CUSTOMER)
def manifest_rows(spark, sf_dir):
    """A folder read twice, with files added in between: the first reading is known by then, and the
    cells of the new files change a column's type."""
    path = scratch_path(spark, "known")
    rows = table(spark, sf_dir, "customer").select(*_COLUMNS)
    debt = F.col("c_acctbal") < 0
    # Whole amounts only, then all of them.
    writers.write_csv(rows.filter(debt).withColumn("c_acctbal", F.floor("c_acctbal")), f"{path}/debt")
    before = readers.read_any(spark, f"{path}").agg(F.count("*").alias("n")).first()["n"]
    writers.write_csv(rows.filter(~debt), f"{path}/rest")
    writers.write_csv(rows.filter(debt), f"{path}/debt", mode="overwrite")
    after = readers.read_any(spark, path)
    if before != rows.filter(debt).count():
        raise AssertionError("the first reading lost rows")
    return after.select(*_COLUMNS)


@query("""SELECT doc_id, text, source FROM documents""")
def roundtrip_csv_documents(spark, sf_dir):
    """Texts with quotes, commas and line ends survive a CSV file."""
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return readers.read_csv(spark, path, multi_line=True, infer=False).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source"
    )


# A file is one task's to write, so its size follows from the splits and not from the table.
_SPLITS_PER_FILE = 4


@query("""SELECT doc_id, text, source FROM documents""")
def csv_documents_in_splits(spark, sf_dir):
    """Files longer than a split, or one of all texts, whose wrapped cells are cut by the edges of splits."""
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    writers.write_csv(rows.repartition(max(1, size // (_SPLITS_PER_FILE * split_bytes(spark)))), path)
    return readers.read_csv(spark, path, multi_line=True, infer=False, in_splits=True).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source"
    )


@query("""SELECT doc_id, text, source FROM documents""")
def json_arrays_in_splits(spark, sf_dir):
    """One array of all texts of a source, an element a line, read in splits."""
    path = scratch_path(spark, "arrays")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    first = F.min("doc_id").over(Window.partitionBy("source"))
    line = F.concat(F.when(F.col("doc_id") == first, "[").otherwise(","), F.to_json(F.struct("doc_id", "text", "source")))
    lines = rows.select(F.col("source").alias("file"), F.col("doc_id").alias("place"), line.alias("value"))
    ends = lines.groupBy("file").agg((F.max("place") + 1).alias("place"), F.lit("]").alias("value"))
    lines.unionByName(ends).repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy(
        "file").text(path)
    return readers.read_json(spark, path, in_splits=True).select("doc_id", "text", "source")


@query("""SELECT o_orderkey, o_orderstatus, o_custkey FROM orders""")
def roundtrip_json_tree(spark, sf_dir):
    path = scratch_path(spark, "tree")
    nested = F.to_variant_object(F.struct(
        "o_orderkey", F.struct("o_orderstatus", "o_custkey").alias("facts")
    ))
    writers.write_json_tree(table(spark, sf_dir, "orders").select(nested.alias("tree")), path)
    trees = spark.read.text(path).select(F.try_parse_json("value").alias("tree"))
    return tree_to_rows(trees, "tree", {
        "o_orderkey": ("$.o_orderkey", "bigint"),
        "o_orderstatus": ("$.facts.o_orderstatus", "string"),
        "o_custkey": ("$.facts.o_custkey", "bigint"),
    })


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def yaml_documents(spark, sf_dir):
    """JSON to YAML and back, one document per row."""
    text = yaml_to_json(json_to_yaml(F.col("props")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object(text, "$.k").cast("bigint").alias("k")
    )


@query("""SELECT 'order' AS path, 'object' AS types, 1::BIGINT AS depth, count(*) AS frequency FROM orders
UNION ALL SELECT 'order.@id', 'string', 2, count(*) FROM orders
UNION ALL SELECT 'order.tag', 'null,string', 2, 2 * count(*) FROM orders
UNION ALL SELECT 'order.#text', 'string', 2, count(*) FROM orders""")
def xml_documents(spark, sf_dir):
    """Orders as XML documents; the repeated element has one path."""
    text = F.concat(
        F.lit('<?xml version="1.0"?><order id="'), "o_orderkey", F.lit('">'), "o_orderpriority",
        F.lit("<tag> "), "o_orderstatus", F.lit(" </tag><tag/></order>"),
    )
    docs = table(spark, sf_dir, "orders").select(xml_to_json(text).alias("doc"))
    out = path_profile(docs, "doc", root="order", arrays="repeat")
    return out.select(
        "path", F.array_join("types", ",").alias("types"),
        F.col("depth_max").cast("bigint").alias("depth"), "frequency",
    )


def _books(spark, sf_dir):
    return workbooks.make_workbooks(table(spark, sf_dir, "customer"), rows_per_book=500)


@query(_CUSTOMER)
def workbook_table(spark, sf_dir):
    rows = workbooks.workbook_rows(_books(spark, sf_dir)).select("record")
    return workbooks.records_to_table(rows).select(*_COLUMNS)


@query("""SELECT 'Sheet1' AS sheet, 0::BIGINT AS sheet_index""")
def workbook_sheets(spark, sf_dir):
    sheets = workbooks.list_sheets(_books(spark, sf_dir))
    return sheets.select(
        "sheet", F.col("sheet_index").cast("bigint").alias("sheet_index")
    ).distinct()


@query("""SELECT count(*) AS rows, TRUE AS bounded FROM customer""")
def workbook_sizes(spark, sf_dir):
    return _books(spark, sf_dir).agg(
        F.sum("rows").alias("rows"), (F.max("rows") <= 500).alias("bounded")
    )


@query("""SELECT 'xlsx' AS format, 0.99::DOUBLE AS confidence, count(*) AS rows FROM customer""")
def detect_workbooks(spark, sf_dir):
    """Workbook bytes are told by their marks; their rows add up to the table's."""
    books = _books(spark, sf_dir)
    found = detect_formats(books, "content", ["rows"])
    return found.groupBy("format", "confidence").agg(F.sum("rows").alias("rows"))


# Each event makes nine texts.
_EVENTS_PER_TASK = 50_000


def _corpus(spark, sf_dir):
    """Documents, pages, event properties and made-up table files as one corpus."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.col("text").alias("content"))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id")).alias("id"), F.col("html").alias("content"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    # Few bytes of a file make many texts, so the splits of a file are no measure of the work.
    events = events.repartition(max(1, -(-events.count() // _EVENTS_PER_TASK)))
    lines = [
        ("props", F.col("props")),
        ("jsonl", F.concat("props", F.lit("\n"), "props", F.lit("\n"))),
        ("array", F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]"))),
        ("csv", F.concat(F.lit("id,type\n"), "event_id", F.lit(","), "event_type", F.lit("\n"))),
        ("tsv", F.concat(F.lit("id\ttype\n"), "event_id", F.lit("\t"), "event_type", F.lit("\n"))),
        ("yaml", F.concat(F.lit("id: "), "event_id", F.lit("\ntype: "), "event_type")),
        ("xml", F.concat(F.lit("<?xml version='1.0'?><e>"), "event_id", F.lit("</e>"))),
        ("html", F.concat(F.lit("<e><b>"), "event_id", F.lit("</b><br/></e>"))),
        ("marked", F.concat(F.lit("---\n- "), "event_id")),
    ]
    made = F.explode(F.array(*[
        F.struct(F.concat(F.lit(f"{name}-"), F.col("event_id")).alias("id"), text.alias("content"))
        for name, text in lines
    ])).alias("m")
    return docs.unionAll(pages).unionAll(events.select(made).select("m.*"))


# The same judgement in SQL, for texts whose quotes, JSON and markup need no parsing by hand.
_DETECT_SQL = r"""
WITH corpus AS (
  SELECT 'props-' || event_id AS id, 'json' AS format, 0.95::DOUBLE AS confidence FROM events
  UNION ALL SELECT k || '-' || event_id, f, c FROM events CROSS JOIN (VALUES
    ('jsonl', 'jsonl', 1.0::DOUBLE), ('array', 'json', 0.98), ('csv', 'csv', 1.0),
    ('tsv', 'tsv', 0.95), ('yaml', 'yaml', 0.8), ('xml', 'xml', 0.99), ('html', 'xml', 0.85),
    ('marked', 'yaml', 0.95)) v(k, f, c)),
texts AS (
  SELECT 'doc-' || doc_id AS id, text AS t FROM documents UNION ALL
  SELECT 'page-' || page_id, html FROM pages),
bare AS (SELECT id, t, regexp_replace(regexp_replace(regexp_replace(t, '"[^"]*"', '', 'g'),
    '\r\n?', chr(10), 'g'), '\n+$', '') AS b,
  list_filter(string_split_regex(regexp_replace(t, '[\r\n]+$', ''), '\r\n|\r|\n'),
    lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#')) AS lines FROM texts),
runs AS (SELECT id, t, lines, string_split(regexp_replace(b, '[^,\n]+', '', 'g'), chr(10)) AS by_comma,
  string_split(regexp_replace(b, '[^\t\n]+', '', 'g'), chr(10)) AS by_tab,
  string_split(regexp_replace(b, '[^;\n]+', '', 'g'), chr(10)) AS by_semi,
  string_split(regexp_replace(b, '[^|\n]+', '', 'g'), chr(10)) AS by_pipe FROM bare),
even AS (SELECT id, t, lines, len(by_comma) AS n,
  len(list_filter(by_comma, lambda x: x = by_comma[1])) AS ec, by_comma[1] <> '' AS hc,
  len(list_filter(by_tab, lambda x: x = by_tab[1])) AS et, by_tab[1] <> '' AS ht,
  len(list_filter(by_semi, lambda x: x = by_semi[1])) AS es, by_semi[1] <> '' AS hs,
  len(list_filter(by_pipe, lambda x: x = by_pipe[1])) AS ep, by_pipe[1] <> '' AS hp FROM runs),
found AS (SELECT *, CASE WHEN hc AND ec >= n * 0.95 THEN ',' WHEN ht AND et >= n * 0.95 THEN 't'
    WHEN hs AND es >= n * 0.95 THEN ';' WHEN hp AND ep >= n * 0.95 THEN '|' END AS d FROM even),
judged AS (SELECT id, d, n,
  CASE WHEN d IS NULL OR n < 2 THEN 0.0 ELSE round(least(
    (CASE d WHEN ',' THEN ec WHEN 't' THEN et WHEN ';' THEN es ELSE ep END - 1) / (n - 1)::DOUBLE
    + CASE d WHEN ',' THEN 0.1 ELSE 0 END, CASE d WHEN 't' THEN 0.95 ELSE 1.0 END), 3) END AS csv,
  CASE WHEN d = 't' AND n < 2 THEN 0.4 WHEN d = 't' AND et = n THEN 0.95 WHEN d = 't' THEN 0.6
       WHEN d IS NOT NULL THEN 0.05 ELSE 0.0 END AS tsv,
  CASE WHEN starts_with(ltrim(t), '<') THEN 0.05 ELSE 0.0 END AS xml,
  CASE WHEN trim(t) = '' THEN 0.0 WHEN starts_with(ltrim(t), '---') THEN 0.95
    WHEN len(lines) = 0 THEN 0.1
    WHEN len(list_filter(lines, lambda x: NOT starts_with(x, ' '))) > 0
      AND len(list_filter(lines, lambda x: NOT starts_with(x, ' ') AND NOT regexp_matches(x,
        '^(-( |$)|("[^"]*"|''[^'']*''|[^\s#&*!|>''"%@`{}\[\],][^:#]*?)\s*:(\s|$)|---|\.\.\.)'))) = 0
      THEN 0.8
    WHEN NOT regexp_matches(t, '(?m):[ \t]|:$|\s#')
      AND NOT regexp_matches(ltrim(t), '^[%@`&*!|>''"\[\]{},]') THEN 0.5 ELSE 0.0 END AS yaml
  FROM found),
best AS (SELECT id, greatest(csv, tsv, xml, yaml) AS c, csv, tsv, xml, yaml FROM judged)
SELECT id, format, confidence FROM corpus UNION ALL
SELECT id, CASE WHEN c < 0.4 THEN 'unknown' WHEN xml = c THEN 'xml' WHEN tsv = c THEN 'tsv'
  WHEN csv = c THEN 'csv' ELSE 'yaml' END, c::DOUBLE FROM best"""


@query(_DETECT_SQL)
def detect_corpus(spark, sf_dir):
    return detect_formats(_corpus(spark, sf_dir), "content", ["id"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000""")
def convert_csv_to_jsonl(spark, sf_dir):
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    writers.write_csv(orders, source)
    spec = {"kind": "expression", "expr": "o_totalprice > 200000"}
    convert(spark, source, target, "jsonl", spec, "csv")
    return readers.read_jsonl(spark, target).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def convert_jsonl_to_csv(spark, sf_dir):
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    writers.write_jsonl(
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"), source
    )
    spec = {"kind": "row", "predicate": {"col": "o_orderstatus", "op": "eq", "value": "F"}}
    convert(spark, source, target, "csv", spec, "jsonl")
    return readers.read_csv(spark, target, multi_line=False).drop("o_orderstatus")


@query("""SELECT o_orderstatus, count(*) AS o_orderkey_count FROM orders
WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus""")
def job_analyze(spark, sf_dir):
    """A submitted analysis job, from its message to the stored result."""
    source, base = scratch_path(spark, "upload"), scratch_path(spark, "store")
    writers.write_jsonl(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), source
    )
    path = run_job(spark, {
        "job_id": "j1", "user_id": "u1", "kind": "analyze",
        "params": {
            "input": {"ref": source, "format": "jsonl"},
            "operations": [{"kind": "filter", "mode": "row",
                            "predicate": "o_orderpriority = '1-URGENT'"}],
            "analysis": "group_by",
            "options": {"by": ["o_orderstatus"], "agg": {"o_orderkey": ["count"]}},
        },
    }, base)
    return readers.read_jsonl(spark, path).select("o_orderstatus", "o_orderkey_count")


@query("""SELECT sum(length('{"c_custkey":' || c_custkey || '}') + 1)::BIGINT AS bytes, TRUE AS named
FROM customer""")
def blob_listing(spark, sf_dir):
    path = scratch_path(spark, "blobs")
    writers.write_jsonl(apply_filter(
        table(spark, sf_dir, "customer"), {"kind": "column", "keep": ["c_custkey"]}
    ), path)
    blobs = readers.list_blobs(spark, path, "*.json")
    return blobs.agg(
        F.sum("length").alias("bytes"), F.every(F.col("path").endswith(".json")).alias("named")
    )


@query("""SELECT count(*) AS shown, TRUE AS kept FROM (SELECT 1 FROM lineitem
WHERE l_quantity > 20 LIMIT 20)""")
def preview_csv(spark, sf_dir):
    """A preview of a file: with known types nothing is read ahead."""
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "lineitem"), path)
    spec = {"kind": "row", "predicate": {"col": "l_quantity", "op": "gt", "value": 20}}
    shown = preview_path(
        spark, path, spec, fmt="csv", multi_line=False, schema="l_orderkey bigint, l_quantity double"
    )
    return shown.agg(F.count(F.lit(1)).alias("shown"), F.every(F.col("l_quantity") > 20).alias("kept"))
