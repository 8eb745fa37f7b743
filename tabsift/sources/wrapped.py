"""Delimited files whose quoted cells hold line ends, read in splits.

What a line does is a map between two states: a record begins, or a quoted cell goes on. The maps of a
split's lines compose to the map of the split, those of a file's splits to the state every split begins
in. With that known each split cuts its own records; only a record that a split edge cuts is put together
from its pieces in a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsift.session import scratch_path

#: Bytes of the table of splits that go to every task; files with more are read by one task each.
MOST_EDGES = 64 << 20

# Maps between the states, as bits: whether a cell is open after a line at whose start none was, and
# whether one is after a line at whose start one was. A third bit marks lines with a bare CR.
_KEEPS = 2
_BARE = 4


def _line_map(value: Column, sep: str) -> Column:
    """What a line does to the state. A quote counts where a cell begins; one within a cell that began
    without is a letter, and what follows a closing quote belongs to the cell up to the delimiter."""
    other = f"[^{re.escape(sep)}]*+"
    inner = '(?:[^"]++|"")*+'
    cells = f'(?:(?:"{inner}"{other}|(?!"){other}){re.escape(sep)})*+'
    quoted = value.contains('"')

    def matches(pattern: str) -> Column:
        return F.when(quoted, F.regexp_like(value, F.lit(pattern)))

    opens = F.coalesce(matches(rf'\A{cells}"{inner}\z'), F.lit(False))
    goes_on = F.coalesce(
        matches(rf'\A{inner}\z') | matches(rf'\A{inner}"{other}{re.escape(sep)}{cells}"{inner}\z'), F.lit(True))
    bare = F.regexp_like(value, F.lit(r"\r(?!\z)"))
    return (opens.cast("int") + 2 * goes_on.cast("int") + _BARE * bare.cast("int")).cast("byte")


def _lines(spark: SparkSession, paths, sep: str) -> DataFrame:
    """``path, start, map, value`` of every line, in the order of each split. A line's own end may be CR LF."""
    value = F.col("value")
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return lines.select("path", "start", _line_map(value, sep).alias("map"), "value")


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """Path, start, first and next row of the stretches of a batch that lie in one split."""
    n = batch.num_rows
    if not n:
        return
    paths, starts = batch.column("path"), batch.column("start").to_numpy()
    new = starts[1:] != starts[:-1]
    new |= pc.not_equal(paths.slice(1), paths.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.nonzero(new)[0] + 1).tolist(), n]
    for a, b in zip(edges[:-1], edges[1:]):
        yield paths[a].as_py(), int(starts[a]), a, b


def _applied(line_map: int, state: int) -> int:
    return line_map >> state & 1


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of every split, ``path, start, closed, open, bare``: the state after it, by that before."""
    key, after, bare = None, [0, 1], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]], pa.int64()),
             *[pa.array([s], pa.int32()) for s in (*after, bare)]], names=["path", "start", "closed", "open", "bare"])

    for batch in batches:
        maps = batch.column("map").to_numpy()
        for path, start, a, b in stretches(batch):
            if (path, start) != key:
                if key is not None:
                    yield row()
                key, after, bare = (path, start), [0, 1], 0
            part = maps[a:b]
            bare |= int((part & _BARE).any())
            for m in part[part != _KEEPS].tolist():
                after = [_applied(m, s) for s in after]
    if key is not None:
        yield row()


def _begins(splits: DataFrame) -> DataFrame:
    """``path, start, inside``: whether a cell is open where a split begins, for all but the first of a
    file; a row at -1 for a file that ends in an open cell."""
    order = Window.partitionBy("path").orderBy("start")
    # A split swaps the states, keeps them, or leaves one of them whatever was before.
    swaps = splits.withColumn("swaps", F.count_if(F.col("closed") > F.col("open")).over(order))
    fixed = F.last(F.when(F.col("closed") == F.col("open"), F.struct("closed", "swaps")), ignorenulls=True).over(order)
    after = swaps.withColumn("fixed", fixed).withColumn(
        "after", (F.coalesce(F.col("fixed.closed") - F.col("fixed.swaps"), F.lit(0)) + F.col("swaps")) % 2)
    begins = after.select(
        "path", "start", F.lag("after", 1, 0).over(order).cast("int").alias("inside"),
        (F.lead("start").over(order).isNull() & (F.col("after") == 1)).alias("unclosed"))
    ends = F.when(F.col("unclosed"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = begins.select("path", "start", "inside", F.explode(ends).alias("end"))
    return rows.select(
        "path", F.when(F.col("end"), -1).otherwise(F.col("start")).alias("start"),
        F.when(F.col("end"), 1).otherwise(F.col("inside")).alias("inside")).filter("start <> 0")


PIECES = "path string, start long, place int, record string"
# Places of the pieces of a record that a split edge cuts; whole records have their number in the split.
# FIRST is the tail of a file's first split that begins with it.
TAIL, MIDDLE, HEAD, FIRST = -1, -2, -3, -4


def _cut_records(pieces: bool):
    """Records of each split, or only the pieces at its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_lines, inside, begun, count = None, [], 0, False, 0

        def rows(places, records):
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()),
                 pa.array(places, pa.int32()), pa.array(records, pa.string())],
                names=["path", "start", "place", "record"])

        def ended():
            """What is open at the end of a split."""
            if key is not None and inside and pieces:
                tail = TAIL if key[1] or count else FIRST
                yield rows([tail if begun else MIDDLE], ["\n".join(open_lines)])

        for batch in batches:
            maps = batch.column("map").to_numpy()
            states, values = batch.column("inside"), batch.column("value")
            for path, start, a, b in stretches(batch):
                if (path, start) != key:
                    yield from ended()
                    key, open_lines, count = (path, start), [], 0
                    inside = states[a].as_py()
                    if inside is None:
                        raise ValueError(f"the splits of {path} are not those it was judged by; read it again")
                    # Whether the record now open began in this split.
                    begun = not inside
                texts = values.slice(a, b - a).to_pylist()
                if start == 0 and not count and not open_lines:
                    texts[0] = texts[0].removeprefix("﻿")
                part = maps[a:b]
                records, at = [], 0
                for i in [*np.nonzero(part != _KEEPS)[0].tolist(), None]:
                    if not inside:
                        # Lines up to the next that opens a cell are records of their own.
                        stop = len(texts) if i is None else i
                        records += texts[at:stop]
                        at = stop
                    if i is None:
                        open_lines += texts[at:] if inside else []
                        break
                    was, inside = inside, _applied(int(part[i]), inside)
                    if inside and not was:
                        open_lines, begun = [], True
                    if was and not inside:
                        whole = "\n".join([*open_lines, *texts[at:i + 1]])
                        if begun:
                            records.append(whole)
                        elif pieces:
                            yield rows([HEAD], [whole])
                        open_lines, begun, at = [], True, i + 1
                    elif not was and not inside:
                        records.append(texts[i])
                        at = i + 1
                records = [r[:-1] if r.endswith("\r") else r for r in records]
                records = [r for r in records if r]
                if records and not pieces:
                    yield rows(list(range(count, count + len(records))), records)
                count += len(records)
        yield from ended()

    return run


def joined_pieces(pieces: DataFrame, glue: str) -> DataFrame:
    """``path, record, place`` of the records that split edges cut; the place is that of the first piece."""
    order = Window.partitionBy("path").orderBy("start", "place")
    begins = F.last(F.when(F.col("place").isin(TAIL, FIRST), F.col("start")), ignorenulls=True).over(order)
    # The texts stay out of the window.
    owners = pieces.select("path", "start", "place").withColumn("owner", begins)
    texts = pieces.join(owners, ["path", "start", "place"]).groupBy("path", F.col("owner").alias("start")).agg(
        F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"), F.min("place").alias("place"))
    return texts.select("path", F.array_join(F.col("parts.record"), glue).alias("record"), "place")


def wrapped_records(spark: SparkSession, paths, sep: str) -> DataFrame | None:
    """``path, record`` of every record but a file's first, which is its header; blank lines are none.

    Reads the files once for the states of their splits, and again for the pieces where there are splits
    that begin within a cell. A file may end in an open cell, whose last line end is then dropped. None
    where lines end in a bare CR or the splits outgrow ``MOST_EDGES``.
    """
    lines = _lines(spark, paths, sep)
    target = scratch_path(spark, "splits")
    lines.select("path", "start", "map").mapInArrow(
        _split_maps, "path string, start long, closed int, open int, bare int").write.parquet(target)
    splits = spark.read.parquet(target)
    if not splits.filter("bare = 1").isEmpty():
        return None
    target = scratch_path(spark, "edges")
    _begins(splits).write.parquet(target)
    edges = spark.read.parquet(target)
    facts = edges.agg(
        F.coalesce(F.sum(F.length("path") + 16), F.lit(0)).alias("size"), F.count_if(F.col("inside") == 1).alias("cut")).first()
    if facts["size"] > MOST_EDGES:
        return None
    edges = F.broadcast(edges.select(F.col("path").alias("_path"), F.col("start").alias("_start"), "inside"))
    known = lines.join(edges, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")), "left").select(
        "path", "start", "map", "value", F.when(F.col("start") == 0, 0).otherwise(F.col("inside")).alias("inside"))
    records = known.mapInArrow(_cut_records(False), PIECES).filter("start > 0 OR place > 0").select("path", "record")
    if not facts["cut"]:
        return records
    target = scratch_path(spark, "pieces")
    cut = joined_pieces(known.mapInArrow(_cut_records(True), PIECES), "\n")
    # The first record of a file is its header.
    cut.filter(F.col("place") > FIRST).select(
        "path", F.regexp_replace("record", r"\r\z", "").alias("record")).write.parquet(target)
    return records.unionByName(spark.read.parquet(target))


def wrapped_rows(spark: SparkSession, paths, sep: str, width: int) -> DataFrame | None:
    """``_c0 ... , _path`` of every record, cells by their place."""
    records = wrapped_records(spark, paths, sep)
    if records is None:
        return None
    schema = ", ".join(f"_c{i} string" for i in range(width))
    row = F.from_csv("record", F.lit(schema), {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    return records.select(row.alias("r"), F.col("path").alias("_path")).select("r.*", "_path")
