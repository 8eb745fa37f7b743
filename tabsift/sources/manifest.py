"""What is known of files: detected formats and column types, kept by path, time and length.

Two tables in the shared folder are appended to whenever files are judged. A listing joined to them
tells which files are new or changed, and only those are scanned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tabsift.operators.infer import column_facts, merged_types
from tabsift.session import shared_dir
from tabsift.sources.detect import FILE_COLUMNS, detect_files

KEY = ["path", "time", "length"]
_TYPES = "path string, time timestamp, length long, reading string, column string, fits int, digits int"


def listed(spark: SparkSession, path) -> DataFrame:
    """``path, time, length`` of every file below a path; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_size").alias("length"))


def _table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """What has been written so far; two writers may have judged the same file."""
    try:
        return spark.read.schema(schema).parquet(_folder(spark, name)).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/manifest-1/{name}"


def _formats(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Listed files with what is known of them; ``lines`` is null where nothing is."""
    return files.join(_table(spark, "formats", FILE_COLUMNS), KEY, "left")


def _judge(spark: SparkSession, path, files: DataFrame, new: DataFrame) -> None:
    """Detect the formats of new files and write them down; a blank file gets 0 lines and no format."""
    new = new.select(*KEY)
    paths = [r["path"] for r in new.collect()]
    every = isinstance(path, str) and len(paths) == files.count()
    found = detect_files(spark, path if every else paths)
    rows = new.join(found.drop("time", "length"), "path", "left")
    rows.withColumn("lines", F.coalesce("lines", F.lit(0).cast("long"))).select(*found.columns).write.mode(
        "append").parquet(_folder(spark, "formats"))


def known_formats(spark: SparkSession, path) -> DataFrame:
    """``detect_files`` of all files below a path, of which only new and changed ones are read.

    Blank files have no row.
    """
    # Listed once: a DataFrame of files keeps its listing.
    files = listed(spark, path)
    new = _formats(spark, files).filter("lines IS NULL")
    if not new.isEmpty():
        _judge(spark, path, files, new)
    return _formats(spark, files).filter("lines > 0")


def format_groups(spark: SparkSession, path) -> list:
    """``format, telling, n, wraps, delimiters, head, heads`` of the files below a path, by format and by
    whether a file has more than one line; ``heads`` tells whether their first lines differ, ``head`` is
    the hash of one of them."""
    every = listed(spark, path)
    for _ in range(2):
        files = _formats(spark, every)
        groups = files.groupBy(
            "format", (F.col("lines") > 1).alias("telling"), F.col("lines").isNull().alias("new")).agg(
            F.count("*").alias("n"), F.max("wraps").alias("wraps"), F.collect_set("delimiter").alias("delimiters"),
            F.min("head").alias("head"), (F.min("head") != F.max("head")).alias("heads")).collect()
        if not any(r["new"] for r in groups):
            break
        _judge(spark, path, every, files.filter("lines IS NULL"))
    return [r for r in groups if r["format"] is not None]


def known_types(
    spark: SparkSession, path, reading: str, columns: list[str], rows: Callable[[list[str] | None], DataFrame]
) -> dict[str, str]:
    """The types that the text columns of all files below a path can be cast to.

    ``rows`` gives the rows of some files, or of all, with their file in ``_path``; ``reading`` names
    the options they are read by. Types of single files merge, so unchanged files are not read again.
    """
    for _ in range(2):
        known = _table(spark, "types", _TYPES).filter(F.col("reading") == reading)
        facts = listed(spark, path).join(known, KEY, "left")
        types = merged_types(facts, columns)
        if None not in types:
            break
        files = facts.filter("reading IS NULL").select(*KEY)
        new = [r["path"] for r in files.collect()]
        every = len(new) == listed(spark, path).count()
        found = column_facts(rows(None if every else new), columns, "_path")
        files = listed(spark, path if every else new)
        # A file without rows is known by a row without a column's name.
        files.join(found, files["path"] == found["_path"], "left").select(
            *KEY, F.lit(reading).alias("reading"), F.coalesce("column", F.lit("")).alias("column"), "fits", "digits",
        ).write.mode("append").parquet(_folder(spark, "types"))
    return {n: types.get(n, "string") for n in columns}
