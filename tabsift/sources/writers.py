"""Writers: DataFrames to directories of part files in seven formats, and to topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.errors import NOT_TABULAR, UNKNOWN_OUTPUT_FORMAT, TabsiftError
from tabsift.sources.documents import json_to_yaml
from tabsift.sources.readers import is_tree
from tabsift.sources.workbooks import make_workbooks, records_to_table


def _flat(df: DataFrame) -> DataFrame:
    """Nested and variant cells as JSON text: delimited files hold scalars only."""
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    (
        _flat(df).write.mode(mode).option("header", True).option("sep", sep)
        .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(df, path, sep="\t", mode=mode)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, the DataFrame's columns in order, nulls written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_tree(df: DataFrame, path: str, tree: str = "tree", mode: str = "error") -> None:
    """One document per line."""
    df.select(F.to_json(F.col(tree)).alias("value")).write.mode(mode).text(path)


def write_xml(
    df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "rows", mode: str = "error"
) -> None:
    """Columns named ``@x`` become attributes, ``#text`` the element's text."""
    (
        df.write.mode(mode).format("xml").option("rowTag", row_tag).option("rootTag", root_tag)
        .option("attributePrefix", "@").option("valueTag", "#text")
        .option("declaration", 'version="1.0" encoding="UTF-8"').save(path)
    )


def write_yaml(
    df: DataFrame, path: str, mode: str = "error", rows_per_file: int = 100_000
) -> None:
    """Each part file is one YAML list of maps, small enough to be loaded as one document."""
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    (
        df.select(json_to_yaml(record, as_item=True).alias("value"))
        .write.mode(mode).option("maxRecordsPerFile", rows_per_file).text(path)
    )


def write_xlsx(
    df: DataFrame, path: str, mode: str = "error", rows_per_book: int = 100_000
) -> None:
    """Workbooks of bounded size as a ``path, rows, content`` table."""
    make_workbooks(df, rows_per_book).write.mode(mode).parquet(path)


def write_yaml_tree(df: DataFrame, path: str, tree: str = "tree", mode: str = "error") -> None:
    """One YAML document per row, each after a ``---`` line."""
    text = F.concat(F.lit("---\n"), json_to_yaml(F.to_json(F.col(tree))))
    df.select(text.alias("value")).write.mode(mode).text(path)


def write_xml_tree(df: DataFrame, path: str, tree: str = "tree", mode: str = "error") -> None:
    """One element per document, typed by a pass over all of them."""
    records = df.select(F.to_json(F.col(tree)).alias("record"))
    write_xml(records_to_table(records), path, "document", "documents", mode)


WRITERS = {
    "csv": write_csv,
    "tsv": write_tsv,
    "json": write_jsonl,
    "jsonl": write_jsonl,
    "xml": write_xml,
    "yaml": write_yaml,
    "xlsx": write_xlsx,
}
TREE_WRITERS = {
    "json": write_json_tree,
    "jsonl": write_json_tree,
    "xml": write_xml_tree,
    "yaml": write_yaml_tree,
}


def write_any(df: DataFrame, path: str, fmt: str, **options) -> None:
    """Write rows, or documents as read into a single ``tree`` column."""
    if fmt not in WRITERS:
        raise TabsiftError(UNKNOWN_OUTPUT_FORMAT, f"no writer for {fmt}")
    if not is_tree(df):
        WRITERS[fmt](df, path, **options)
    elif fmt in TREE_WRITERS:
        TREE_WRITERS[fmt](df, path, tree=df.columns[0], **options)
    else:
        raise TabsiftError(NOT_TABULAR, f"flatten the documents before writing {fmt}")


def write_topic(df: DataFrame, servers: str, checkpoint: str, topic: str | None = None):
    """Send ``key, value`` (and ``topic``, unless one is given) rows; needs the Kafka connector.

    A streaming query resumes from ``checkpoint``; the idempotent producer keeps retries single.
    """
    columns = ["key", "value"] + ([] if topic else ["topic"])
    writer = (
        df.select(*columns).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("kafka.enable.idempotence", "true")
        .option("kafka.acks", "all").option("checkpointLocation", checkpoint)
    )
    return (writer.option("topic", topic) if topic else writer).start()
