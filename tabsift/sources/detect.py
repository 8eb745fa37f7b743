"""Format detection over a column of whole documents, as Spark expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.functions.exprs import json_items, once, whole_json
from tabsift.session import scratch_path
from tabsift.sources.structure import shapes

# Formats and the confidence each finding is worth.
FORMATS = ("xlsx", "json", "jsonl", "xml", "tsv", "csv", "yaml")  # first wins a tie
ACCEPT = 0.4
XLSX_SURE, XLSX_BROKEN, XLSX_OTHER_ZIP = 0.99, 0.4, 0.1
JSON_TABLE, JSON_OBJECT, JSON_ARRAY = 0.98, 0.95, 0.7
JSONL_SINGLE = 0.45
XML_DECLARED, XML_WELL_FORMED, XML_MALFORMED = 0.99, 0.85, 0.05
YAML_MARKED, YAML_TREE, YAML_SCALAR, YAML_JSON, YAML_NULL = 0.95, 0.8, 0.5, 0.3, 0.1
TSV_EVEN, TSV_UNEVEN, TSV_SINGLE, TSV_OTHER = 0.95, 0.6, 0.4, 0.05
COMMA_BONUS = 0.1
DELIMITERS = (",", "\t", ";", "|")

# A delimiter counts as found when this share of the lines holds it equally often.
_EVEN_SHARE = 0.95

_TAG = r"""<(/?)([A-Za-z_:][\w:.\-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>"""
_NOT_ELEMENT = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>"


def _zero() -> Column:
    return F.lit(0.0)


def _line_ends(text: Column) -> Column:
    """All line ends as ``\\n``. Here and below a plain search goes before a pattern, as it costs far less."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def _rare_end(text: Column) -> Column:
    """Whether a Unicode line end is last, which a pattern with ``$`` looks past."""
    return reduce(or_, [text.endswith(c) for c in "\u0085\u2028\u2029"])


def json_confidence(text: Column) -> Column:
    lead = F.substring(F.ltrim(text), 1, 1)

    def judged(found: Column) -> Column:
        # Parsed once: what is named twice inside a lambda would be parsed twice.
        items = F.try_variant_get(found[0], "$", "array<variant>")
        objects = F.forall(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
        return F.when(F.size(found) == 1, F.when(lead == "{", JSON_OBJECT).when(objects, JSON_TABLE).otherwise(
            JSON_ARRAY)).otherwise(_zero())

    return F.when(lead.isin("{", "["), once(json_items(text), judged)).otherwise(_zero())


def jsonl_confidence(text: Column) -> Column:
    """Share of the non-blank lines that are JSON objects."""
    return F.when(text.isNotNull(), F.coalesce(_objects_by_line(text), _value_in_line(text)))


def _value_in_line(text: Column) -> Column:
    # A failed parse is dear, so only what can begin a JSON value is tried.
    start = F.regexp_like(text, F.lit(r"""^\s*[\[{"0-9tfn-]"""))
    return F.when(whole_json(F.when(start, text)).isNotNull(), JSONL_SINGLE).otherwise(_zero())


def _objects_by_line(text: Column) -> Column:
    """The share of the non-blank lines that are JSON objects; null for a text of one line."""

    def judged(lines: Column) -> Column:
        good = F.size(F.filter(lines, lambda x: F.when(F.ltrim(x).startswith("{"), F.size(json_items(x)) == 1)))
        return F.when(F.size(lines) == 0, _zero()).when(F.size(lines) > 1, good / F.size(lines))

    lines = F.filter(F.split(_line_ends(text), "\n"), lambda x: F.trim(x) != "")
    return F.when(F.ltrim(text).startswith("["), _zero()).when(
        text.contains("\n") | text.contains("\r") | (F.trim(text) == ""), once(lines, judged))


def well_formed(text: Column) -> Column:
    """Whether the tags of a markup text nest properly around a single root."""
    odd = text.contains("<!") | text.contains("<?")
    bare = F.when(odd, F.regexp_replace(text, _NOT_ELEMENT, "")).otherwise(text)
    return once(bare, lambda b: once(
        F.regexp_extract_all(b, F.lit(_TAG), F.lit(0)), lambda tags: _nested(b, tags)))


def _nested(bare: Column, found: Column) -> Column:
    """Whether the tags found nest around one root and no other ``<`` is left beside them."""

    def openers(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("<")))

    tags = F.transform(
        F.filter(found, lambda t: ~t.endswith("/>")),
        lambda t: F.regexp_extract(t, r"^<(/?[\w:.\-]+)", 1),
    )
    nested = F.aggregate(
        tags,
        F.struct(
            F.array().cast("array<string>").alias("open"), F.lit(True).alias("ok"),
            F.lit(0).alias("roots"),
        ),
        lambda acc, tag: F.when(
            tag.startswith("/"),
            F.struct(
                F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
                .alias("open"),
                (
                    acc["ok"] & (F.size(acc["open"]) > 0)
                    & F.try_element_at(acc["open"], F.lit(-1)).eqNullSafe(F.substr(tag, F.lit(2)))
                ).alias("ok"),
                acc["roots"].alias("roots"),
            ),
        ).otherwise(F.struct(
            F.array_append(acc["open"], tag).alias("open"),
            acc["ok"].alias("ok"),
            (acc["roots"] + F.when(F.size(acc["open"]) == 0, 1).otherwise(0)).alias("roots"),
        )),
        lambda acc: acc["ok"] & (F.size(acc["open"]) == 0) & (acc["roots"] <= 1),
    )
    stray = openers(bare) > openers(F.array_join(found, ""))
    return F.when((F.size(found) == 0) | stray, False).otherwise(nested)


def xml_confidence(text: Column) -> Column:
    lead = F.ltrim(text)
    return (
        F.when(lead.startswith("<?xml"), XML_DECLARED)
        .when(~lead.startswith("<"), _zero())
        .when(well_formed(F.when(lead.startswith("<"), text)), XML_WELL_FORMED)
        .otherwise(XML_MALFORMED)
    )


def _delimited(text: Column) -> Column:
    """``delimiter, rows, body_even`` of the delimiter the lines agree on, or null.

    Only delimiters and line ends are kept of the text, so the work per line is one comparison
    with the header's run of delimiters.
    """
    # Quoted cells go first, with the delimiters and line ends in them.
    bare = F.when(text.contains('"'), F.regexp_replace(text, r'"[^"]*"', "")).otherwise(text)

    def judged_text(text: Column) -> Column:
        header = F.substring_index(text, "\n", 1)
        marked = reduce(or_, [header.contains(d) for d in DELIMITERS])
        return F.when(marked, F.when(text.contains("\n"), judged_rows(text)).otherwise(one_row(text)))

    def one_row(text: Column) -> Column:
        return F.coalesce(*[F.when(text.contains(d), F.struct(
            F.lit(-i).alias("order"), F.lit(d).alias("delimiter"), F.lit(1).alias("rows"),
            F.lit(0).alias("body_even"))) for i, d in enumerate(DELIMITERS)])

    def judged_rows(text: Column) -> Column:
        return once(F.regexp_replace(text, r"[^,\t;|\n]+", ""), lambda m: F.array_max(F.array_compact(F.array(*[
            reading(m, i, d) for i, d in enumerate(DELIMITERS)
        ]))))

    def reading(marks: Column, order: int, delimiter: str) -> Column:
        runs = F.split(F.regexp_replace(marks, rf"[^{delimiter}\n]+", ""), "\n")

        def judged(runs: Column) -> Column:
            same = F.size(F.filter(runs, lambda x: x == runs[0]))
            # The header row speaks for the mode: at 95 % agreement both are the same count.
            return F.when(
                same >= F.size(runs) * F.lit(_EVEN_SHARE),
                F.struct(
                    F.lit(-order).alias("order"), F.lit(delimiter).alias("delimiter"),
                    F.size(runs).alias("rows"), (same - 1).alias("body_even"),
                ),
            )

        header = F.substring_index(marks, "\n", 1)
        return F.when(header.contains(delimiter), once(runs, judged))

    def unended(text: Column) -> Column:
        return F.when(_rare_end(text), F.regexp_replace(text, r"\n+$", "")).otherwise(F.rtrim(text, F.lit("\n")))

    return once(bare, lambda b: once(_line_ends(b), lambda e: once(unended(e), judged_text)))


def csv_confidence(text: Column, found: Column | None = None) -> Column:
    """Share of body rows as wide as the header, with a bonus for the comma.

    Tab-separated text scores what TSV scores, which then wins the tie.
    """
    found = _delimited(text) if found is None else found
    share = found["body_even"] / (found["rows"] - 1)
    bonus = F.when(found["delimiter"] == ",", COMMA_BONUS).otherwise(_zero())
    top = F.when(found["delimiter"] == "\t", TSV_EVEN).otherwise(1.0)
    return F.when(
        found.isNull() | (found["rows"] < 2) | text.contains("\u0000"), _zero()
    ).otherwise(F.round(F.least(share + bonus, top), 3))


def tsv_confidence(text: Column, found: Column | None = None) -> Column:
    found = _delimited(text) if found is None else found
    return (
        F.when(found.isNull(), _zero())
        .when(found["delimiter"] != "\t", TSV_OTHER)
        .when(found["rows"] < 2, TSV_SINGLE)
        .when(found["body_even"] == found["rows"] - 1, TSV_EVEN)
        .otherwise(TSV_UNEVEN)
    )


def yaml_confidence(text: Column) -> Column:
    """Document marker, then block structure, then a plain scalar.

    Structure means that every line at the margin is an entry, a key or a comment.
    """
    lead = F.ltrim(text)
    entry = F.lit(
        r"""^(-( |$)|("[^"]*"|'[^']*'|[^\s#&*!|>'"%@`{}\[\],][^:#]*?)\s*:(\s|$)|---|\.\.\.)"""
    )
    clean = ~F.substring(lead, 1, 1).isin(*"%@`&*!|>'\"[]{},") & (
        ~text.contains(":") | ~F.regexp_like(text, F.lit(r"(?m):(?:[ \t]|$)"))) & (
        ~text.contains("#") | ~F.regexp_like(text, F.lit(r"\s#")))

    def block(lines: Column) -> Column:
        margin = F.filter(lines, lambda x: ~x.startswith(" "))
        structured = F.forall(margin, lambda x: F.regexp_like(x, entry)) & (F.size(margin) > 0)
        return (
            F.when(F.size(lines) == 0, YAML_NULL)
            .when(structured, YAML_TREE)
            .when(clean, YAML_SCALAR)
            .otherwise(_zero())
        )

    # Blank lines are dropped, so the line ends at the end need not go first.
    body = F.when(_rare_end(text), F.regexp_replace(text, r"[\r\n]+$", "")).otherwise(text)
    lines = F.filter(F.split(_line_ends(body), "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    return (
        F.when(F.trim(text) == "", _zero())
        .when(lead.startswith("---"), YAML_MARKED)
        .when(lead.startswith("{") | lead.startswith("["),
              F.when(F.regexp_like(F.rtrim(text), F.lit(r"[}\]]\s*$")), YAML_JSON)
              .otherwise(_zero()))
        .otherwise(once(lines, block))
    )


def xlsx_confidence(content: Column) -> Column:
    """From the raw bytes: the archive mark and the name of the workbook part."""
    entry = F.lit(bytearray(b"xl/workbook.xml"))
    directory = F.lit(bytearray(b"PK\x05\x06"))
    return (
        F.when(~F.startswith(content, F.lit(bytearray(b"PK\x03\x04"))), _zero())
        .when(~F.contains(content, directory), XLSX_BROKEN)
        .when(F.contains(content, entry), XLSX_SURE)
        .otherwise(XLSX_OTHER_ZIP)
    )


def _unmarked(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, (1 << 31) - 1)).otherwise(text)


def detect_formats(df: DataFrame, content: str, keep: list[str] | None = None) -> DataFrame:
    """``keep..., format, confidence`` per document; under 0.4 the format is ``unknown``.

    ``content`` is a binary or text column and is judged whole. Row-local, so no shuffle.
    """
    kept = [F.col(k) for k in keep or []]
    raw = F.col(content).cast("binary")
    data = df.select(
        *kept, raw.alias("_raw"),
        _unmarked(F.col(content).cast("string")).alias("_text"),
    )
    text = F.col("_text")
    data = data.select("*", xlsx_confidence(F.col("_raw")).alias("_xlsx")).select(
        *kept, "_xlsx",
        # A workbook's bytes are no text, so the text readings skip them.
        F.when(F.col("_xlsx") == 0, text).alias("_text"),
    )
    data = data.select(
        "*", _delimited(text).alias("_found"), _objects_by_line(text).alias("_objects"), xml_confidence(text).alias("_xml"),
    )
    # Of two neighbouring lines of one document, one is no whole object, nor is the first or the last; so a
    # text half of whose lines are objects is no document, and is not parsed as one. A bracket too many may
    # end the parse early, so that texts with one are parsed in any case.
    single = F.col("_objects").isNull()
    parses = single | (F.col("_objects") < 0.5) | text.contains("]")
    data = data.select("*", json_confidence(F.when(parses, text)).alias("_json"))
    # Lines of one parsed document may be even as well; that does not make them rows.
    parsed = (F.col("_json") > 0) | (F.col("_xml") > XML_MALFORMED)
    readings = {
        "xlsx": F.col("_xlsx"),
        "json": F.col("_json"),
        # A text of one line in brackets has been parsed.
        "jsonl": F.when(~single, F.col("_objects")).when(F.col("_json") > 0, JSONL_SINGLE)
        .when(~F.ltrim(text).startswith("{"), _value_in_line(text)),
        "xml": F.col("_xml"),
        "tsv": F.when(parsed, 0.0).otherwise(tsv_confidence(text, F.col("_found"))),
        "csv": F.when(parsed, 0.0).otherwise(csv_confidence(text, F.col("_found"))),
        "yaml": yaml_confidence(text),
    }
    best = F.array_max(F.array(*[
        F.struct(
            F.coalesce(readings[f], _zero()).alias("confidence"), F.lit(-i).alias("order"),
            F.lit(f).alias("format"),
        ) for i, f in enumerate(FORMATS)
    ]))
    return data.select(*kept, best.alias("b")).select(
        *kept,
        F.when(F.col("b.confidence") >= ACCEPT, F.col("b.format")).otherwise("unknown")
        .alias("format"),
        F.col("b.confidence").alias("confidence"),
    )


# ---- files, from their lines ---------------------------------------------------------------------

_ENTRY = (
    r"""^(-( |$)|("[^"]*"|'[^']*'|[^\s#&*!|>'"%@`{}\[\],][^:#]*?)\s*:(\s|$)|---|\.\.\.)"""
)


# How a file may begin, kept with the code of its first letter in one number.
_CODES = 1024
_MARKS = ("<?xml", "---", "PK\u0003\u0004")


def _line_facts(lines: DataFrame) -> DataFrame:
    """What one line says: its place, its ends, its delimiters and what it could be a part of."""
    value = F.col("value")
    # Most lines hold none of what the patterns look for, so a plain search goes first.
    quoted = value.contains('"')
    bare = F.when(quoted, F.regexp_replace(value, r'"[^"]*"', "")).otherwise(value)
    quotes = F.when(quoted, F.length(value) - F.length(F.replace(value, F.lit('"')))).otherwise(0)
    lead = F.substring(F.ltrim(value), 1, 1)
    strings = F.when(quoted, F.regexp_replace(value, r'"(?:[^"\\]|\\.)*"', "")).otherwise(value)
    bracketed = reduce(or_, [value.contains(sign) for sign in "{}[]"])

    def signs(some: str) -> Column:
        return F.length(strings) - F.length(F.translate(strings, some, ""))

    keyed = value.contains(":")
    listed = value.startswith("-") | value.startswith("...")
    commented = F.ltrim(value).startswith("#")
    margin = ~value.startswith(" ") & ~commented
    return lines.select(
        "path", "time", "length", F.xxhash64("value").alias("head"), F.col("place"), (
            F.least(F.ascii(lead), F.lit(_CODES - 1))
            + reduce(add, [F.when(F.ltrim(value).startswith(m), _CODES << i).otherwise(0)
                           for i, m in enumerate(_MARKS)])
        ).alias("opens"),
        F.ascii(F.substring(F.rtrim(value), -1, 1)).alias("closes"),
        (quotes % 2 == 1).alias("wraps"),
        *[(F.length(bare) - F.length(F.replace(bare, F.lit(d)))).alias(f"d{i}")
          for i, d in enumerate(DELIMITERS)],
        ((lead == "{") & whole_json(F.when(lead == "{", value)).isNotNull()).alias("object"),
        F.when(bracketed, signs("{[") - signs("}]")).otherwise(0).alias("depth"),
        commented.alias("comment"), margin.alias("margin"),
        F.when(margin & (keyed | listed), F.regexp_like(value, F.lit(_ENTRY))).otherwise(False).alias("entry"),
        F.when(keyed | value.contains("#"), F.regexp_like(value, F.lit(r":[ \t]|:$|\s#")))
        .otherwise(False).alias("marked"),
        value.contains("xl/workbook.xml").alias("workbook"),
        value.contains("PK\u0005\u0006").alias("directory"),
    )


FILE_COLUMNS = ("path string, time timestamp, length long, lines long, format string, confidence double, "
                "delimiter string, wraps boolean, head long")


def detect_files(spark, path) -> DataFrame:
    """``path, time, length, lines, format, confidence, delimiter, wraps, head`` of every file below a
    path; blank files have no row.

    One scan in splits: lines are judged where they are read, lines with equal delimiters merge
    before the shuffle, and a file is the sum of its lines, so its size does not matter and files of
    a folder are judged each for itself. Only files that begin and end like a JSON or XML document
    are read once more, for the structure of the whole file (``structure``): what does not parse is
    none. ``delimiter`` is that of delimited rows, ``wraps`` tells whether a quoted cell may hold a
    line end, ``head`` is a hash of the first line.
    """
    target = scratch_path(spark, "files")
    _file_facts(spark, path).write.parquet(target)
    files = spark.read.parquet(target)
    shaped = files.withColumns({
        "_json": (F.col("opens") < 128) & F.col("opens").isin(ord("{"), ord("[")) & (F.col("depth") == 0)
        & F.col("closes").isin(ord("}"), ord("]")) & ((F.col("objects") < F.col("n")) | (F.col("n") == 1)),
        "_xml": (F.col("opens") == ord("<")) & (F.col("closes") == ord(">")),
    })
    shape = spark.createDataFrame([], "path string, shape string")
    for kind in ("json", "xml"):
        paths = [r["path"] for r in shaped.filter(F.col(f"_{kind}")).select("path").collect()]
        if paths:
            # The whole folder, where all of it is meant, is listed by Spark itself.
            every = isinstance(path, str) and len(paths) == files.count()
            shape = shape.unionByName(shapes(spark, path if every else paths, kind))
    known = files.join(shape.withColumnRenamed("path", "_shaped"), F.col("path") == F.col("_shaped"), "left")
    known = known.select("path", "time", "length", F.col("n").alias("lines"), "head", *_file_reading()).select(
        "path", "time", "length", "lines",
        F.when(F.col("b.confidence") >= ACCEPT, F.col("b.format")).otherwise("unknown").alias("format"),
        F.col("b.confidence").alias("confidence"), F.col("found.delimiter").alias("delimiter"), "wraps", "head",
    )
    target = scratch_path(spark, "formats")
    known.write.parquet(target)
    return spark.read.parquet(target)


def beside_others(files: DataFrame) -> DataFrame:
    """``detect_files`` with files of one line judged by those beside them, as writers leave such files of
    partitions with no row or one: a bare header goes with the delimited files that begin with it, and one
    object with JSON Lines."""
    telling = files.filter("lines > 1")
    heads = telling.filter(F.col("format").isin("csv", "tsv")).groupBy("head").agg(
        F.min(F.struct("format", "delimiter")).alias("_with"))
    listed = telling.filter("format = 'jsonl'").groupBy(F.col("format").alias("_kind")).agg(
        F.max(F.col("lines") > 1).alias("_jsonl"))
    known = files.join(heads, "head", "left").join(
        F.broadcast(listed), F.when(F.col("lines") == 1, "jsonl") == F.col("_kind"), "left")
    bare = (F.col("lines") == 1) & F.col("_with").isNotNull()
    single = F.col("_jsonl") & (F.col("format") == "json") & (F.col("confidence") == JSON_OBJECT)
    return known.withColumns({
        "format": F.when(bare, F.col("_with.format")).when(single, "jsonl").otherwise(F.col("format")),
        "delimiter": F.when(bare, F.col("_with.delimiter")).otherwise(F.col("delimiter")),
    }).select(*files.columns)


def _file_facts(spark, path) -> DataFrame:
    """The sums of every file's lines."""
    reader = spark.read.option("recursiveFileLookup", True)
    lines = reader.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_size").alias("length"),
        # A task reads fewer lines than the splits of a file lie apart in bytes, so this number
        # rises through a file; whole numbers keep the sums below in hash tables.
        (F.col("_metadata.file_block_start")
         + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("place"),
    ).filter(F.trim(F.col("value")) != "")
    counts = [f"d{i}" for i in range(len(DELIMITERS))]
    facts = _line_facts(lines)
    alike = facts.groupBy("path", "wraps", *counts).agg(
        F.count("*").alias("n"), F.min("place").alias("first"),
        F.min_by("opens", "place").alias("opens"), F.max_by("closes", "place").alias("closes"),
        F.min_by("head", "place").alias("head"), F.max("time").alias("time"), F.max("length").alias("length"),
        F.max("place").alias("last"), F.count_if("object").alias("objects"), F.sum("depth").alias("depth"),
        F.count_if("comment").alias("comments"), F.count_if("margin").alias("margins"),
        F.count_if("entry").alias("entries"), F.max("marked").alias("marked"),
        F.max("workbook").alias("workbook"), F.max("directory").alias("directory"),
    )
    head = alike.groupBy(F.col("path").alias("_path")).agg(
        *[F.min_by(c, "first").alias(f"h{i}") for i, c in enumerate(counts)])
    same = [F.sum(F.when((F.col(c) == F.col(f"h{i}")) & ~F.col("wraps"), F.col("n")).otherwise(0)).alias(f"s{i}")
            for i, c in enumerate(counts)]
    joined = alike.join(head, F.col("path") == F.col("_path"))
    return joined.groupBy("path").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("wraps"), 0).otherwise(F.col("n"))).alias("rows"),
        F.min_by("opens", "first").alias("opens"), F.max_by("closes", "last").alias("closes"),
        F.min_by("head", "first").alias("head"), F.max("time").alias("time"), F.max("length").alias("length"),
        *[F.max(f"h{i}").alias(f"h{i}") for i in range(len(counts))], *same,
        *[F.sum(c).alias(c) for c in ("objects", "depth", "comments", "margins", "entries")],
        *[F.max(c).alias(c) for c in ("wraps", "marked", "workbook", "directory")],
    )


def _file_reading() -> list[Column]:
    """The best reading of a file's sums, by the same worth as that of a whole text."""
    n, rows = F.col("n"), F.col("rows")
    code = F.col("opens").bitwiseAND(F.lit(_CODES - 1))
    declared, dashed, zipped = (
        F.col("opens").bitwiseAND(F.lit(_CODES << i)) != 0 for i in range(len(_MARKS)))
    lead, closes = (F.when(c < 128, F.char(c)).otherwise("") for c in (code, F.col("closes")))
    json = (
        F.when(F.col("shape") == "object", JSON_OBJECT).when(F.col("shape") == "table", JSON_TABLE)
        .when(F.col("shape") == "list", JSON_ARRAY).otherwise(_zero())
    )
    jsonl = F.when(lead == "[", _zero()).when(
        n == 1, F.when(F.col("objects") == 1, JSONL_SINGLE).otherwise(_zero())
    ).otherwise(F.col("objects") / n)
    xml = (
        F.when(declared, XML_DECLARED).when(lead != "<", _zero())
        .when(F.col("shape") == "element", XML_WELL_FORMED).otherwise(XML_MALFORMED)
    )
    found = F.array_max(F.array_compact(F.array(*[
        F.when(
            (F.col(f"h{i}") > 0) & (F.col(f"s{i}") >= rows * F.lit(_EVEN_SHARE)),
            F.struct(F.lit(-i).alias("order"), F.lit(d).alias("delimiter"), rows.alias("rows"),
                     (F.col(f"s{i}") - 1).alias("body_even")),
        ) for i, d in enumerate(DELIMITERS)
    ])))
    xlsx = (
        F.when(~zipped, _zero()).when(~F.col("directory"), XLSX_BROKEN)
        .when(F.col("workbook"), XLSX_SURE).otherwise(XLSX_OTHER_ZIP)
    )
    structured = (F.col("margins") > 0) & (F.col("entries") == F.col("margins"))
    clean = ~F.col("marked") & ~lead.isin(*"%@`&*!|>'\"[]{},")
    yaml = (
        F.when(dashed, YAML_MARKED)
        .when(lead.isin("{", "["), F.when(closes.isin("}", "]"), YAML_JSON).otherwise(_zero()))
        .when(F.col("comments") == n, YAML_NULL)
        .when(structured, YAML_TREE).when(clean, YAML_SCALAR).otherwise(_zero())
    )
    sure = (json > 0) | (xml > XML_MALFORMED) | zipped
    readings = {
        "xlsx": xlsx, "json": json, "jsonl": jsonl, "xml": xml,
        "tsv": F.when(sure, 0.0).otherwise(tsv_confidence(F.lit(""), found)),
        "csv": F.when(sure, 0.0).otherwise(csv_confidence(F.lit(""), found)), "yaml": yaml,
    }
    best = F.array_max(F.array(*[
        F.struct(F.coalesce(readings[f], _zero()).alias("confidence"), F.lit(-i).alias("order"),
                 F.lit(f).alias("format"))
        for i, f in enumerate(FORMATS)
    ]))
    return [best.alias("b"), found.alias("found"), "wraps"]


def confidences(df: DataFrame, content: str, keep: list[str] | None = None) -> DataFrame:
    """``keep...`` and one confidence column per format."""
    text = F.regexp_replace(F.col(content).cast("string"), "^﻿", "")
    found = _delimited(text)
    return df.select(
        *[F.col(k) for k in keep or []],
        xlsx_confidence(F.col(content).cast("binary")).alias("xlsx"),
        json_confidence(text).alias("json"), jsonl_confidence(text).alias("jsonl"),
        xml_confidence(text).alias("xml"), tsv_confidence(text, found).alias("tsv"),
        csv_confidence(text, found).alias("csv"), yaml_confidence(text).alias("yaml"),
    )

