"""Readers: files of seven formats to DataFrames, plus listings and topics."""

from __future__ import annotations

import re
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tabsift.errors import MIXED_FORMATS, NOT_FOUND, UNKNOWN_FORMAT, TabsiftError
from tabsift.functions.exprs import unread_reason, whole_json
from tabsift.operators.infer import apply_types
from tabsift.session import split_bytes
from tabsift.sources import workbooks
from tabsift.sources.arrays import LINE_END, array_lines
from tabsift.sources.detect import DELIMITERS, beside_others
from tabsift.sources.documents import xml_to_json, yaml_to_json
from tabsift.sources.manifest import format_groups, known_formats, known_types
from tabsift.sources.wrapped import wrapped_rows

CORRUPT = "_corrupt_record"
#: What ``read_each`` lists the files under that it cannot read.
UNREAD = "unread"


def list_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Recursive listing: ``path, modificationTime, length``; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "modificationTime", "length")


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole objects: ``path, modificationTime, length, content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _longer_than_a_split(spark: SparkSession, path) -> bool:
    return (list_blobs(spark, path).agg(F.max("length")).first()[0] or 0) > split_bytes(spark)


def _first_lines(spark: SparkSession, path) -> DataFrame:
    """``path, header`` of every file that is not blank."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    return lines.filter(F.trim(F.col("value")) != "").groupBy("path").agg(
        F.regexp_replace(F.min_by("value", "place"), "^\ufeff", "").alias("header"))


def _one_head(groups: list) -> bool:
    return len({g["head"] for g in groups}) == 1 and not any(g["heads"] for g in groups)


class _Delimited:
    """The rows of delimited files, whatever their number of orders of columns."""

    def __init__(self, spark: SparkSession, path, sep: str, multi_line: bool | None, encoding: str | None,
                 one_header: bool | None = None, in_splits: bool | None = None):
        self.spark, self.path, self.sep, self.encoding = spark, path, sep, encoding
        self.in_splits = in_splits
        if one_header is None:
            one_header = list_blobs(spark, path).limit(2).count() < 2
        if multi_line is None or not one_header:
            groups = format_groups(spark, path)
            one_header = one_header or _one_head(groups)
            multi_line = any(g["wraps"] for g in groups) if multi_line is None else multi_line
        self.multi_line = multi_line
        self.orders, self.names, self.width = None, None, 0
        if not one_header:
            self._match_headers()

    def _reader(self):
        reader = (
            self.spark.read.option("sep", self.sep).option("escape", '"').option("multiLine", self.multi_line)
            .option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
        )
        return reader if self.encoding is None else reader.option("encoding", self.encoding)

    def _match_headers(self) -> None:
        """A row per file with the place of every column in it, unless all files have one first line."""
        first = _first_lines(self.spark, self.path)
        if first.select("header").distinct().limit(2).count() < 2:
            return
        # No header has more cells than delimiters and one.
        self.width = first.agg(F.max(F.size(F.split("header", re.escape(self.sep))))).first()[0]
        cells = self._from_csv()
        heads = first.select("path", cells.alias("cells"))
        n = heads.count()
        names = heads.select("path", F.posexplode("cells").alias("at", "name")).groupBy("name").agg(
            F.count_distinct("path").alias("files"), F.min(F.struct("at", "path")).alias("first"))
        if names.filter(F.col("files") == n).isEmpty():
            raise TabsiftError(
                MIXED_FORMATS, f"the first lines of the files below {self.path} share no column; "
                "files without headers are read by Spark's own csv reader")
        lead = heads.orderBy("path").first()
        known = [r["name"] for r in names.orderBy("first.at", "first.path").select("name").collect()]
        self.names = lead["cells"] + [c for c in known if c not in set(lead["cells"])]
        self.names = list(dict.fromkeys(self.names))
        at = F.transform(F.array(*map(F.lit, self.names)), lambda c: F.array_position("cells", c).cast("int"))
        self.orders = heads.select(F.col("path").alias("_file"), at.alias("_at"))

    def _from_csv(self):
        schema = ", ".join(f"_c{i} string" for i in range(self.width))
        row = F.from_csv("header", F.lit(schema), {"sep": self.sep, "escape": '"'})
        return F.array_compact(F.array(*[row[f"_c{i}"] for i in range(self.width)]))

    def rows(self, paths: list[str] | None = None, with_path: bool = False) -> DataFrame:
        """All columns as text; with the file they come from in ``_path`` where it is asked for."""
        path = self.path if paths is None else paths
        if self.orders is None:
            return _one_header(self._reader(), path, self._placed, with_path)
        # The first line of a file is left out by the reader, which tells columns by their place.
        rows = self._placed(path, self.width).select(
            F.array(*[f"_c{i}" for i in range(self.width)]).alias("_cells"), "_path")
        # One row per file: broadcast by Catalyst where that is small.
        rows = rows.join(self.orders, rows["_path"] == self.orders["_file"])
        cells = [
            F.when(F.col("_at")[i] > 0, F.try_element_at("_cells", F.col("_at")[i])).alias(n or "_empty")
            for i, n in enumerate(self.names)]
        return rows.select(*cells, *["_path"] * with_path)

    def _placed(self, path, width: int) -> DataFrame:
        """``_c0 ... , _path``: the cells of all rows but the first of a file, by their place."""
        # Lines are cut as UTF-8, so files of another encoding are not read in splits.
        if self.multi_line and self.encoding is None and (
                _longer_than_a_split(self.spark, path) if self.in_splits is None else self.in_splits):
            rows = wrapped_rows(self.spark, path, self.sep, width)
            if rows is not None:
                return rows
        schema = ", ".join(f"_c{i} string" for i in range(width))
        rows = self._reader().option("header", True).option("enforceSchema", True).schema(schema).csv(path)
        return rows.select("*", F.col("_metadata.file_path").alias("_path"))

    def typed(self) -> DataFrame:
        """Columns cast to the types that all their cells fit."""
        df = self.rows()
        text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if not text:
            return df
        reading = f"csv {self.sep!r} {self.multi_line} {self.encoding} {len(self.names or [])}"
        return apply_types(df, known_types(
            self.spark, self.path, reading, text, lambda paths: self.rows(paths, with_path=True)))


def _delimited(
    spark: SparkSession, path, sep: str, multi_line: bool | None, infer: bool,
    schema: str | None, encoding: str | None = None, one_header: bool | None = None, in_splits: bool | None = None,
) -> DataFrame:
    source = _Delimited(spark, path, sep, multi_line, encoding, one_header, in_splits)
    if schema is not None:
        known = T.StructType.fromDDL(schema)
        return apply_types(source.rows(), {f.name: f.dataType.simpleString() for f in known})
    return source.typed() if infer else source.rows()


def _one_header(reader, path, placed, with_path: bool) -> DataFrame:
    """The rows of files with one header, whose names the reader makes different by their places."""
    names = reader.option("header", True).csv(path).columns
    rows = placed(path, len(names))
    stems = [n[:-len(str(i))] for i, n in enumerate(names) if n.endswith(str(i))]
    head = reader.option("header", False).csv(path).limit(1).first() if len(set(stems)) < len(stems) else None
    kept = dict(zip(names, range(len(names))))
    if head is not None:
        said = ["" if n is None else n.lstrip("\ufeff") for n in head]
        if len(set(said)) < len(said) and len(said) == len(names):
            # A repeated header keeps the last column of that name, in the first one's place.
            kept = {n or "_empty": i for n, i in {n: i for i, n in enumerate(said)}.items()}
    return rows.select(*[F.col(f"_c{i}").alias(n) for n, i in kept.items()], *["_path"] * with_path)


def read_csv(
    spark, path, sep=",", multi_line=None, infer=True, schema=None, encoding=None, one_header=None, in_splits=None,
) -> DataFrame:
    """Delimited text with a header row, typed unless ``infer`` is off.

    ``sep="auto"`` takes the delimiter that detection finds; ``encoding`` names one other than
    UTF-8. Files of one folder may list their columns in different orders. Inference reads every
    row. With ``schema`` (types of the columns to cast) and ``multi_line`` (whether quoted cells
    hold line ends) a single file is not read ahead, so a preview stops early; ``one_header`` says that
    all files have the same first line. Files whose cells wrap are read in splits where one is longer
    than a split, or as ``in_splits`` says; the rows are the same.
    """
    if sep == "auto":
        rows = known_formats(spark, path).select("delimiter").distinct().collect()
        known = {r["delimiter"] for r in rows} & set(DELIMITERS)
        if len(known) != 1:
            raise TabsiftError(MIXED_FORMATS, f"no one delimiter below {path}")
        sep = known.pop()
    return _delimited(spark, path, sep, multi_line, infer, schema, encoding, one_header, in_splits)


def read_tsv(spark, path, multi_line=None, infer=True, schema=None, one_header=None, in_splits=None) -> DataFrame:
    return _delimited(spark, path, "\t", multi_line, infer, schema, one_header=one_header, in_splits=in_splits)


def _first_line(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The first line that matches, read without looking further."""
    row = spark.read.text(path).filter(F.col("value").rlike(pattern)).first()
    return row["value"] if row else None


def read_json(
    spark: SparkSession, path: str, schema: str | None = None, in_splits: bool | None = None,
) -> DataFrame:
    """A JSON array of objects per file as a table with the union of their keys; any other
    document as a ``tree``. A file that is no JSON fails the query that reads it.

    Arrays are read in splits where a file is longer than a split, or as ``in_splits`` says: their elements
    are written to the shared folder first, as a table of JSON texts.
    """
    reader = spark.read.option("multiLine", True)
    lead = _first_line(spark, path, r"\S")
    listed = lead is not None and lead.lstrip("\ufeff \t").startswith("[")
    lines = None
    if listed and (_longer_than_a_split(spark, path) if in_splits is None else in_splits):
        lines = array_lines(spark, path)
    if lines is not None:
        reader, path = spark.read.option("lineSep", LINE_END), lines
    if schema is not None:
        return reader.schema(schema).json(path)
    if listed:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        if isinstance(path, list) and lines is None:
            reader = reader.schema(_json_schema(spark, path))
        table = reader.json(path)
        if lines is not None or table.columns != [CORRUPT]:
            return table
    return _trees(read_json_tree(spark, path))


def _json_schema(spark: SparkSession, paths: list[str]) -> T.StructType:
    """The schema of whole documents, a text each. Spark infers that of files in few tasks and copies the list
    of all paths for every file, which grows with the square of their number."""
    texts = spark.read.text(paths, wholetext=True).select(F.regexp_replace("value", "^\ufeff", ""))
    return spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(texts.rdd.map(itemgetter(0))).schema


def _trees(files: DataFrame) -> DataFrame:
    """The ``tree`` of every file; blank files have none, and one without a tree fails by its name."""
    message = F.concat(F.col("path"), F.lit(" has no tree: "), F.col("reason"))
    tree = F.coalesce("tree", F.raise_error(message).cast("variant"))
    return files.filter("reason IS NULL OR reason <> 'empty'").select(tree.alias("tree"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object per line; keys in the first object's order, bad lines in ``_corrupt_record``."""
    if schema is not None:
        return spark.read.schema(schema).json(path)
    df = spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    head = (
        spark.read.text(path).select(F.json_object_keys("value").alias("k"))
        .filter(F.col("k").isNotNull()).first()
    )
    order = [n for n in dict.fromkeys(head["k"] if head else []) if n in df.columns]
    return df.select(*[f"`{n}`" for n in order + [c for c in df.columns if c not in order]])


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return read_blobs(spark, path).select(
        "path", F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("text")
    )


def read_json_tree(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT per file: ``path, tree, reason``; the reason says why a file has no tree."""
    return _with_reason(_whole_texts(spark, path).select("path", "text", whole_json(F.col("text")).alias("tree")))


def _with_reason(trees: DataFrame) -> DataFrame:
    return trees.select("path", "tree", unread_reason(F.col("text"), F.col("tree")).alias("reason"))


def read_yaml_tree(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT per YAML file: ``path, tree, reason``."""
    texts = _whole_texts(spark, path)
    tree = F.try_parse_json(yaml_to_json(F.col("text"))).alias("tree")
    return _with_reason(texts.select("path", "text", tree))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """YAML lists of maps as a table with the union of their keys; other documents as a ``tree``."""
    trees = _trees(read_yaml_tree(spark, path))
    items = F.try_variant_get("tree", "$", "array<variant>")
    listed = trees.agg(F.every(
        (F.size(items) > 0) & F.forall(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    )).first()[0]
    if not listed:
        return trees
    rows = trees.select(F.explode(items).alias("v")).select(F.to_json("v").alias("record"))
    return workbooks.records_to_table(rows)


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Rows of an XML file: attributes as ``@name``, text beside children as ``#text``.

    Values stay text, trimmed, and empty ones are null. Without ``row_tag`` each document is one
    ``tree``.
    """
    if row_tag is None:
        return _trees(read_xml_tree(spark, path))
    return (
        spark.read.format("xml").option("rowTag", row_tag)
        .option("attributePrefix", "@").option("valueTag", "#text")
        .option("inferSchema", False).option("ignoreSurroundingSpaces", True)
        .option("nullValue", "")
        .load(path)
    )


def read_xml_tree(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT per XML file: ``path, tree, reason``. Values stay text; a file is one task's work, so
    large ones are better read by ``row_tag``."""
    texts = _whole_texts(spark, path)
    # A text declares its own encoding only as bytes; decoded, the declaration must go.
    body = F.regexp_replace("text", r"^\s*<\?xml[^>]*\?>", "")
    return _with_reason(texts.select("path", "text", F.try_parse_json(xml_to_json(body)).alias("tree")))


def is_tree(df: DataFrame) -> bool:
    """Whether a table holds whole documents instead of rows."""
    return len(df.columns) == 1 and isinstance(df.schema[0].dataType, T.VariantType)


def read_xlsx(
    spark: SparkSession, path: str, sheet_name: str | None = None, with_origin: bool = False
) -> DataFrame:
    """A workbook corpus as one typed table; the first sheet unless one is named."""
    rows = workbooks.workbook_rows(read_blobs(spark, path, "*.xlsx"), sheet_name)
    kept = ["path", "sheet", "row"] if with_origin else []
    rows = rows.select(*kept, "record")
    return workbooks.header_order(rows, workbooks.records_to_table(rows), kept)


READERS = {
    "csv": read_csv,
    "tsv": read_tsv,
    "json": read_json,
    "jsonl": read_jsonl,
    "xml": read_xml,
    "yaml": read_yaml,
    "xlsx": read_xlsx,
}


def _odd_lines(spark: SparkSession, path: str, files: DataFrame, others) -> list[str]:
    """Some files of one line that do not go with the other files of a folder, if there are any.

    With delimited files goes a bare header of their columns, with JSON Lines one object, and else
    a file of the same format.
    """
    fmt = others["format"]
    single = F.col("lines") == 1
    if fmt in ("csv", "tsv"):
        if len(others["delimiters"]) > 1:
            return []
        sep = "\t" if fmt == "tsv" else others["delimiters"][0]
        cells = F.array_sort(F.split("header", re.escape(sep)))
        first = files.join(_first_lines(spark, path), "path").select("path", "lines", cells.alias("cells"))
        known = first.filter(~single).select("cells").distinct()
        odd = first.filter(single).join(known, "cells", "left_anti")
    elif fmt == "jsonl":
        line = F.regexp_replace("header", "^\ufeff", "")
        one = F.ltrim(line).startswith("{") & whole_json(line).isNotNull()
        odd = files.filter(single).join(_first_lines(spark, path), "path").filter(~one)
    else:
        same = [fmt, "jsonl"] if fmt == "json" else [fmt]
        odd = files.filter(single & ~F.col("format").isin(same))
    return sorted(r["path"] for r in odd.select("path").limit(5).collect())


def _found(spark: SparkSession, path: str):
    """Format, delimiter and whether cells wrap, of all files below a path, and whether their first lines
    differ; mixed ones are refused."""
    try:
        kinds = format_groups(spark, path)
    except AnalysisException as e:
        raise TabsiftError(NOT_FOUND, path) from e
    if not kinds:
        raise TabsiftError(NOT_FOUND, path)
    telling = [r for r in kinds if r["telling"]]
    if len(telling) == 1 and telling[0]["format"] in ("csv", "tsv") and _one_head(kinds):
        # Files of one line are bare headers.
        return telling[0], False
    if len(telling) == 1 and len(kinds) > 1:
        odd = _odd_lines(spark, path, known_formats(spark, path), telling[0])
        if odd:
            raise TabsiftError(MIXED_FORMATS, f"files of one line below {path} are no {telling[0]['format']} "
                               f"of the same columns: {', '.join(odd)}")
        return telling[0], True
    if len(kinds) > 1:
        said = ", ".join(f"{r['n']} {r['format']}" for r in sorted(kinds, key=lambda r: r["format"]))
        raise TabsiftError(MIXED_FORMATS, f"files of several formats below {path}: {said}")
    if kinds[0]["format"] == "unknown":
        raise TabsiftError(UNKNOWN_FORMAT, f"no format matches {path}")
    return kinds[0], kinds[0]["heads"]


def detect_path(spark: SparkSession, path: str) -> str:
    """The one format of all files below a path, each judged by all of its lines."""
    return _found(spark, path)[0]["format"]


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a path in the given or the detected format.

    Detection also tells the delimiter of delimited files and whether their cells wrap.
    """
    if fmt is None:
        found, differ = _found(spark, path)
        fmt = found["format"]
        if fmt in ("csv", "tsv"):
            options.setdefault("multi_line", found["wraps"])
            options.setdefault("one_header", not differ)
        if fmt == "csv" and "sep" not in options:
            if len(found["delimiters"]) > 1:
                raise TabsiftError(MIXED_FORMATS, f"files of several delimiters below {path}")
            options["sep"] = found["delimiters"][0]
    if fmt not in READERS:
        raise TabsiftError(UNKNOWN_FORMAT, f"no reader for {fmt}")
    return READERS[fmt](spark, path, **options)


def read_each(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """The files of a mixed folder, one table per format. The paths come to the driver, as they do
    for any listing that Spark reads.

    A bare header goes with the files that begin with it, and a file of one object with JSON Lines.
    Files without a known format or a reader are listed under ``UNREAD``: ``path, format``.
    """
    paths: dict[tuple, list[str]] = {}
    wraps: dict[tuple, bool] = {}
    longest: dict[tuple, int] = {}
    for r in beside_others(known_formats(spark, path)).collect():
        key = (r["format"], r["delimiter"] if r["format"] == "csv" else None)
        paths.setdefault(key, []).append(r["path"])
        wraps[key] = wraps.get(key, False) or r["wraps"]
        longest[key] = max(longest.get(key, 0), r["length"])
    out: dict[str, DataFrame] = {}
    unread: list[tuple[str, str]] = []
    for (fmt, sep), files in sorted(paths.items(), key=str):
        if fmt not in READERS:
            unread += [(path, fmt) for path in files]
            continue
        own = dict(options)
        if fmt in ("csv", "tsv"):
            own.setdefault("multi_line", wraps[fmt, sep])
        if fmt == "csv":
            own.setdefault("sep", sep)
        if fmt == "json":
            own.setdefault("in_splits", longest[fmt, sep] > split_bytes(spark))
        df = READERS[fmt](spark, files, **own)
        out[fmt] = out[fmt].unionByName(df, allowMissingColumns=True) if fmt in out else df
    if unread:
        out[UNREAD] = spark.createDataFrame(unread, "path string, format string")
    return out


def read_topic(spark: SparkSession, servers: str, topics: list[str], **options) -> DataFrame:
    """A message stream from the earliest offset: ``key, value, topic, ts`` (needs the Kafka
    connector on the class path)."""
    stream = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
        .options(**options).load()
    )
    return stream.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "topic", F.col("timestamp").alias("ts"),
    )
