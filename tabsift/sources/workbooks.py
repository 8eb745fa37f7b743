"""Workbook corpora: many ``.xlsx`` files read and made by Spark tasks, one file at a time.

A task holds one workbook's bytes and streams its sheets, so a corpus of any size spreads over
the cluster while a single workbook (at most about a million rows) stays in one task.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.errors import NOT_TABULAR, TabsiftError

# Names from the workbook file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BUILT_IN_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH = datetime(1899, 12, 30)

_BATCH = 10_000
ROWS_SCHEMA = (
    "path string, sheet_index int, sheet string, row int, record string"
)
SHEETS_SCHEMA = "path string, sheet_index int, sheet string"


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheet names in order with the archive member of each."""
    root = ET.fromstring(book.read("xl/workbook.xml"))
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in links}

    def member(ref: str) -> str:
        return ref.lstrip("/") if ref.startswith("/") else f"xl/{ref}"

    return [
        (s.get("name"), member(target[s.get(f"{_REL}id")])) for s in root.iter(f"{_MAIN}sheet")
    ]


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter(f"{_MAIN}numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode")), re.I)
    }
    dates = _BUILT_IN_DATES | custom
    styles = root.find(f"{_MAIN}cellXfs")
    return {
        i for i, xf in enumerate(styles if styles is not None else ())
        if int(xf.get("numFmtId", 0)) in dates
    }


def _cell(c, shared: list[str], dates: set[int]):
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    value = c.findtext(f"{_MAIN}v")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return value == "1"
    if kind != "n":
        return value
    number = float(value)
    if int(c.get("s", 0)) in dates:
        return (_EPOCH + timedelta(days=number)).isoformat(sep=" ")
    return int(value) if re.fullmatch(r"-?\d+", value) else number


def _column_index(ref: str) -> int:
    at = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        at = at * 26 + ord(ch) - 64
    return at - 1


def _sheet_rows(book: zipfile.ZipFile, member: str) -> Iterator[list]:
    shared, dates = _shared_texts(book), _date_styles(book)
    with book.open(member) as stream:
        for _, element in ET.iterparse(stream):
            if element.tag != f"{_MAIN}row":
                continue
            row: list = []
            for c in element.iter(f"{_MAIN}c"):
                at = _column_index(c.get("r")) if c.get("r") else len(row)
                row += [None] * (at + 1 - len(row))
                row[at] = _cell(c, shared, dates)
            yield row
            element.clear()


def _records(path: str, content: bytes, sheet: str | None, first_only: bool):
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = _sheet_parts(book)
        chosen = [(i, n, m) for i, (n, m) in enumerate(parts) if sheet is None or n == sheet]
        for index, name, member in chosen[:1] if first_only else chosen:
            rows = _sheet_rows(book, member)
            titles = enumerate(next(rows, []))
            header = [f"col_{i}" if h is None else str(h) for i, h in titles]
            for at, row in enumerate(rows, start=2):
                cells = dict(zip(header, row + [None] * (len(header) - len(row))))
                yield path, index, name, at, json.dumps(cells, ensure_ascii=False, default=str)


def workbook_rows(
    books: DataFrame, sheet_name: str | None = None, all_sheets: bool = False
) -> DataFrame:
    """Sheet rows of a ``path, content`` table: ``path, sheet_index, sheet, row, record``.

    ``record`` is the row as a JSON object under the sheet's header. The first sheet is read
    unless one is named or all are wanted.
    """
    first_only = not all_sheets

    def read(batches):
        for books in batches:
            for path, content in zip(books["path"], books["content"]):
                rows = _records(path, content, sheet_name, first_only)
                while chunk := [r for _, r in zip(range(_BATCH), rows)]:
                    yield pd.DataFrame(
                        chunk, columns=["path", "sheet_index", "sheet", "row", "record"]
                    )

    return books.select("path", "content").mapInPandas(read, ROWS_SCHEMA)


def list_sheets(books: DataFrame) -> DataFrame:
    """Sheet names of a ``path, content`` table: ``path, sheet_index, sheet``."""

    def read(batches):
        for books in batches:
            yield pd.DataFrame(
                [
                    (path, i, name)
                    for path, content in zip(books["path"], books["content"])
                    for i, (name, _) in enumerate(_sheet_parts(zipfile.ZipFile(io.BytesIO(content))))
                ],
                columns=["path", "sheet_index", "sheet"],
            )

    return books.select("path", "content").mapInPandas(read, SHEETS_SCHEMA)


def records_to_table(rows: DataFrame, record: str = "record") -> DataFrame:
    """JSON objects to typed columns; one aggregate job widens the types over all rows."""
    shape = rows.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(record)))).first()[0]
    if not shape or not shape.startswith("OBJECT<"):
        raise TabsiftError(NOT_TABULAR, "the documents are no list of records")
    # An object's type reads like a struct's; names are quoted wherever they need it.
    ddl = re.sub(r"(`(?:[^`]|``)*`)|OBJECT<", lambda m: m.group(1) or "STRUCT<", shape)
    parsed = T.StructType.fromDDL(f"r {ddl}")["r"].dataType
    record_type = _readable(parsed)
    kept = [c for c in rows.columns if c != record]
    return rows.select(*kept, F.from_json(F.col(record), record_type).alias("_r")).select(
        *kept, *[F.col("_r").getField(n).alias(n) for n in record_type.fieldNames()]
    )


def _readable(dtype: T.DataType) -> T.DataType:
    """The type to read a JSON value as: what has no one type reads as text, fractions as doubles."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _readable(f.dataType)) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_readable(dtype.elementType))
    if isinstance(dtype, (T.NullType, T.VariantType)):
        return T.StringType()
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return T.DoubleType()
    return dtype


def header_order(rows: DataFrame, table: DataFrame, kept: list[str]) -> DataFrame:
    """Columns in the order of the first header instead of by name."""
    head = rows.select(F.json_object_keys("record")).first()
    order = [n for n in (head[0] if head else []) if n in table.columns]
    rest = [n for n in table.columns if n not in order and n not in kept]
    return table.select(*[f"`{n}`" for n in kept + order + rest])


# ---- making workbooks --------------------------------------------------------------------------

_CONTENT_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
_LINKS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
    'relationships/{kind}" Target="{target}"/></Relationships>'
)
_WORKBOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>'
)


def _cell_xml(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, (datetime, date)):
        value = value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _book(names: list[str], rows: Iterator[tuple], sheet: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _CONTENT_TYPES)
        book.writestr("_rels/.rels", _LINKS.format(kind="officeDocument", target="xl/workbook.xml"))
        book.writestr("xl/_rels/workbook.xml.rels",
                      _LINKS.format(kind="worksheet", target="worksheets/sheet1.xml"))
        book.writestr("xl/workbook.xml", _WORKBOOK.format(name=escape(sheet)))
        with book.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            for row in [tuple(names), *rows]:
                part.write(f"<row>{''.join(map(_cell_xml, row))}</row>".encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def make_workbooks(df: DataFrame, rows_per_book: int = _BATCH, sheet: str = "Sheet1") -> DataFrame:
    """The table as workbooks of bounded size: ``path, rows, content``.

    Every task cuts its own rows into books, so nothing is shuffled. The books are a table whose
    ``content`` any writer can store.
    """
    names = df.columns
    plain = df.select(*[
        F.col(f"`{f.name}`") if isinstance(
            f.dataType, (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)
        ) else F.col(f"`{f.name}`").cast("string").alias(f.name)
        for f in df.schema
    ])

    def write(batches):
        task, made, held = TaskContext.get().partitionId(), 0, []

        def flush(rows):
            return pd.DataFrame({
                "path": [f"part-{task:05d}-{made:05d}.xlsx"],
                "rows": [len(rows)],
                "content": [_book(names, rows, sheet)],
            })

        for batch in batches:
            columns = [batch[n].astype(object).where(batch[n].notna(), None) for n in names]
            held.extend(zip(*columns))
            while len(held) >= rows_per_book:
                yield flush(held[:rows_per_book])
                held, made = held[rows_per_book:], made + 1
        if held:
            yield flush(held)

    return plain.mapInPandas(write, "path string, rows bigint, content binary")
