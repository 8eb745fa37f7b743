"""Benchmark items inside documents: MinHash containment search with exact verification.

DataFrame functions only, no Python on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.functions.exprs import once
from tabsift.llm.common import written

WORDS = 5
CONTAINMENT_PERCENT = 75
#: The white space of ASCII.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The lower-cased words of a text; null and blank texts have none."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+"))


def _runs(ws: Column, size: int, make) -> Column:
    """``make`` of every run of ``size`` words; none where there are fewer."""
    starts = F.sequence(F.lit(1), F.size(ws) - (size - 1))
    none = F.transform(F.array().cast("array<int>"), lambda i: make(F.slice(ws, i, size)))
    return F.when(F.size(ws) >= size, F.transform(starts, lambda i: make(F.slice(ws, i, size)))).otherwise(none)


def _document(text: Column, short: list[int], make) -> Column:
    """Runs of five words, and of each size that a shorter item has."""
    return once(words(text), lambda ws: F.concat(*[_runs(ws, n, make) for n in (WORDS, *short)]))


def _hash(ws: Column) -> Column:
    return F.xxhash64(ws)


def _joined(ws: Column) -> Column:
    return F.array_join(ws, " ")


def shingle_hashes(text: Column, short: list[int] = ()) -> Column:
    return _document(text, short, _hash)


def shingles(text: Column, short: list[int] = ()) -> Column:
    return F.array_distinct(_document(text, short, _joined))


def _item(text: Column) -> Column:
    """Runs of five words; all words of an item that has fewer, and none of none."""
    def of(ws: Column) -> Column:
        return F.when(F.size(ws).between(1, WORDS - 1), F.array(_joined(ws))).otherwise(_runs(ws, WORDS, _joined))
    return F.array_distinct(once(words(text), of))


def item_shingles(benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """``item_id, shingle, hash, n_item, need, size_class, in_sketch``: every distinct shingle.

    Items are partitioned by size into classes of doubling width. An item of n shingles that is
    contained to ``percent`` misses at most n - need of them, so any n - need + 1 of them hold one
    that is there. A class takes that many for its largest size, those of smallest hash: its MinHash
    sketch, which loses no item.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    rows = rows.groupBy("item_id").agg(F.collect_set("text").alias("_texts"))
    # Texts of a repeated id are one item: all their shingles.
    every = F.array_distinct(F.flatten(F.transform("_texts", _item)))
    rows = rows.select("item_id", every.alias("_s")).select(
        "item_id", F.size("_s").cast("long").alias("n_item"), F.explode("_s").alias("shingle"))
    share = percent / 100
    rows = rows.withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    rows = rows.withColumns({
        "hash": F.xxhash64(F.split("shingle", " ")),
        "need": F.expr(f"(n_item * {percent} + 99) div 100"),
        "_sketch": largest - F.ceil(largest * share) + 1,
    })
    order = F.array_sort(F.collect_list(F.struct("hash", "shingle")))
    ranked = rows.groupBy("item_id", "n_item", "need", "size_class", "_sketch").agg(order.alias("_o"))
    return ranked.select(
        "item_id", "n_item", "need", "size_class", "_sketch", F.posexplode("_o").alias("_rank", "_v")
    ).select("item_id", "_v.shingle", "_v.hash", "n_item", "need", "size_class",
             (F.col("_rank") < F.col("_sketch")).alias("in_sketch"))


def short_sizes(items: DataFrame) -> list[int]:
    """The numbers of words under five that items have: four at most."""
    size = F.size(F.split("shingle", " ")).alias("n")
    return sorted(r["n"] for r in items.select(size).filter(F.col("n") < WORDS).distinct().collect())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``id, _mark, item_id, n_matched, n_item, containment`` of every item found in a document.

    A document holds an item if at least ``percent`` of the item's distinct shingles (five
    lower-cased words; all words of an item that has fewer) are among its runs of as many words, so
    an item of few words is found wherever these stand in a row. Documents are probed with all their shingles, however long
    they are, against the items' sketches; what is found is verified by the shingles themselves.
    Sketches are read back from a table, so Catalyst knows their size: small ones are broadcast,
    others joined by a shuffle. ``_mark`` is a hash of the text that tells rows of one id apart.

    Null and empty texts hold nothing and are never found. Repeated rows are one document here;
    repeated item ids are one item with all its texts. An empty table gives an empty table.
    """
    items = written(item_shingles(benchmark, percent), "items")
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_t"))
    rows = rows.withColumn("_mark", F.xxhash64("_t"))
    short = short_sizes(items)
    probes = rows.select("_id", "_mark", F.explode(shingle_hashes(F.col("_t"), short)).alias("_h"))
    sketch = items.filter("in_sketch").select(F.col("hash").alias("_h"), "item_id")
    found = written(probes.join(sketch, "_h").select("_id", "_mark", "item_id").distinct(), "found")

    keys = found.select(F.col("_id").alias("_cid"), F.col("_mark").alias("_cmark")).distinct()
    near = rows.join(keys, rows["_id"].eqNullSafe(keys["_cid"]) & (rows["_mark"] == keys["_cmark"]), "left_semi")
    own = near.dropDuplicates(["_id", "_mark"]).select(
        "_id", "_mark", F.explode(shingles(F.col("_t"), short)).alias("shingle"))
    pairs = found.join(items.select("item_id", "shingle", "n_item", "need"), "item_id").select(
        F.col("_id").alias("_fid"), F.col("_mark").alias("_fmark"), "item_id",
        F.col("shingle").alias("_shingle"), "n_item", "need")
    shared = own.join(
        pairs, own["_id"].eqNullSafe(pairs["_fid"]) & (own["_mark"] == pairs["_fmark"])
        & (own["shingle"] == pairs["_shingle"]))
    counted = shared.groupBy("_id", "_mark", "item_id", "n_item", "need").agg(
        F.count("*").alias("n_matched"))
    return counted.filter(F.col("n_matched") >= F.col("need")).select(
        F.col("_id").alias(id), "_mark", "item_id", "n_matched", "n_item",
        (F.col("n_matched") / F.col("n_item")).alias("containment"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The documents that hold no item, with all their columns; see ``contaminated``."""
    bad = contaminated(docs, benchmark, percent, id, text).select(
        F.col(id).alias("_bad"), F.col("_mark").alias("_badmark")).distinct()
    bad = written(bad, "contaminated")
    mark = F.xxhash64(docs[text].cast("string"))
    return docs.join(bad, docs[id].cast("long").eqNullSafe(bad["_bad"]) & (mark == bad["_badmark"]), "left_anti")
