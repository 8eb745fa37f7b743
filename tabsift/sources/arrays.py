"""JSON arrays of objects that are longer than a split, read in splits.

No string holds a line end, so what a line adds to the depth is told by the line itself, and the depth at
a split's beginning is a sum over the splits before it. Where a line ends or begins with a comma of the
outer array the file may be cut; the elements between two cuts are a record of a table of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsift.session import scratch_path
from tabsift.sources.structure import shapes
from tabsift.sources.wrapped import HEAD, MIDDLE, MOST_EDGES, PIECES, TAIL, joined_pieces, stretches

#: Ends a record of the table; no JSON text holds it, while line ends between tokens are kept.
LINE_END = "\x1e"


def _lines(spark: SparkSession, paths) -> DataFrame:
    """``path, start, delta, leads, trails, value`` of every line, in the order of each split."""
    value = F.col("value")
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    bare = F.when(value.contains('"'), F.regexp_replace(value, r'"(?:[^"\\]++|\\.)*+"', "")).otherwise(value)
    lines = lines.select("*", bare.alias("bare"))
    delta = F.length(F.translate("bare", "}]", "")) - F.length(F.translate("bare", "{[", ""))
    return lines.select(
        "path", "start", delta.alias("delta"), F.regexp_like("bare", F.lit(r"\A\s*,")).alias("leads"),
        F.regexp_like("bare", F.lit(r",\s*\z")).alias("trails"), "value")


def _cut_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements between two cuts of a split, and the pieces at its edges."""
    key, depth, open_lines, cut = None, 0, [], False

    def rows(places, records):
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()),
             pa.array(places, pa.int32()), pa.array(records, pa.string())], names=["path", "start", "place", "record"])

    def ended():
        # An empty piece keeps what begins the next split from going to an earlier one.
        if key is not None and (cut or open_lines):
            yield rows([TAIL if cut else MIDDLE], ["\n".join(open_lines)])

    for batch in batches:
        deltas, before = batch.column("delta").to_numpy(), batch.column("before")
        leads, trails = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leads", "trails"))
        values = batch.column("value")
        for path, start, a, b in stretches(batch):
            if (path, start) != key:
                yield from ended()
                # A file's beginning is a cut.
                key, open_lines, cut = (path, start), [], start == 0
                if before[a].as_py() is None:
                    raise ValueError(f"the splits of {path} are not those it was judged by")
                depth = before[a].as_py()
            after = depth + np.cumsum(deltas[a:b])
            at_start = np.concatenate(([depth], after[:-1]))
            depth = int(after[-1])
            # Cuts before a line; that after the last line is the one before the next.
            cuts = np.zeros(b - a + 1, bool)
            cuts[:-1] |= leads[a:b] & (at_start == 1)
            cuts[1:] |= trails[a:b] & (after == 1)
            texts, done, records = values.slice(a, b - a).to_pylist(), 0, []
            for i in np.nonzero(cuts)[0].tolist():
                record = "\n".join([*open_lines, *texts[done:i]])
                if cut:
                    records.append(record)
                else:
                    yield rows([HEAD], [record])
                open_lines, cut, done = [], True, i
            open_lines += texts[done:]
            if records:
                yield rows(list(range(len(records))), records)
    yield from ended()


def array_lines(spark: SparkSession, paths) -> str | None:
    """A folder of JSON texts, ended by ``LINE_END``, with the elements of all files below some paths; None where one is no list
    of objects, or the splits outgrow ``MOST_EDGES``.

    The files are read for their structure, for the depths and for the elements, each time in splits; only
    elements that a split edge cuts are put together in a shuffle. A file without line ends is one task's.
    """
    if not shapes(spark, paths, "json").filter("shape <> 'table'").isEmpty():
        return None
    lines = _lines(spark, paths)
    depths = lines.groupBy("path", "start").agg(F.sum("delta").alias("delta"))
    before = F.sum("delta").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    target = scratch_path(spark, "edges")
    depths.select("path", "start", F.coalesce(before, F.lit(0)).alias("before")).filter("start > 0").write.parquet(target)
    edges = spark.read.parquet(target)
    if (edges.agg(F.sum(F.length("path") + 16)).first()[0] or 0) > MOST_EDGES:
        return None
    edges = F.broadcast(edges.select(F.col("path").alias("_path"), F.col("start").alias("_start"), "before"))
    known = lines.join(edges, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")), "left").select(
        "path", "start", "delta", "leads", "trails", "value",
        F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(F.col("before")).alias("before"))
    target = scratch_path(spark, "elements")
    known.mapInArrow(_cut_elements, PIECES).write.parquet(target)
    found = spark.read.parquet(target)
    whole = found.filter("place >= 0").select("record")
    records = whole.unionByName(joined_pieces(found.filter("place < 0"), "\n").select("record"))
    # All elements are objects, so brackets and commas at the ends are those of the outer array.
    bare = F.regexp_replace(F.regexp_replace("record", r"\A[\s,\[\x{FEFF}]+", ""), r"[\s,\]]+\z", "")
    texts = records.select(bare.alias("bare")).filter("bare <> ''")
    target = scratch_path(spark, "array-lines")
    texts.select(F.concat(F.lit("["), "bare", F.lit("]")).alias("value")).write.option("lineSep", LINE_END).text(target)
    return target
