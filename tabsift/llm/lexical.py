"""Ranked search of items in all documents; documents with equal bags are scored once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import texts_of, written
from tabsift.operators.joins import keyed_join
from tabsift.operators.ranking import first_rows

#: Fixed values of the score.
SCALE, TF_SCALE, TF_STEP, LENGTH_STEP = 1000, 1_000_000_000, 1000, 12
LENGTH_BASE, LENGTH_SHARE = 100, 25

TOP = 20
#: Bytes of item texts that are searched for at once; more items go in further blocks.
BLOCK_BYTES = 4 << 20
#: Cells of one scoring step, and candidates kept before they are cut to the best.
CELLS, KEPT = 1 << 21, 1 << 18
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20

#: A term is a run of letters, digits and everything beyond ASCII; A to Z in lower case.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_BAG = "doc_id long, n long, bag binary"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    data = (text or "").encode().translate(_LETTERS)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + PIECE) if at + PIECE < len(data) else len(data)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


class Block:
    """Some items with the vocabulary of all of them; terms are numbered from 0."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids: list[object] = []
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[int] = []
        self.repeats: list[int] = []
        self.starts: list[int] = []
        for item_id, text in items:
            bag = Counter(t for part in terms(text) for t in part)
            if not bag:
                continue
            self.ids.append(item_id)
            self.starts.append(len(self.terms))
            for term, n in sorted(bag.items()):
                self.terms.append(self.vocabulary.setdefault(term, len(self.vocabulary)))
                self.repeats.append(n)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item that score above 0.

    A document keeps the counts of the terms that items hold and its length factor ``m``. Documents
    with equal counts and ``m`` are one class: classes are found by a 128-bit hash and the whole
    bag, each is scored once, and the best are expanded to their members by ascending id. Each task
    keeps the best classes of every item only, so nothing grows with documents times items. A class
    with a third of all documents is one row after partial aggregation, and its members are cut to
    ``top`` in every task before they are shuffled.

    Items are searched for in blocks of about ``block_bytes`` of text, which bounds what tasks and
    driver hold; every block reads all documents.

    Null or empty texts have no terms: such a document is never found, such an item has no rows.
    Equal rows of ``items`` count once; different texts under one id are ranked apart. Each row of
    ``docs`` is a document of its own, also where ids repeat; a null id comes last among equal
    scores. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    queries = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    schema = f"item int, item_id {items.schema['item_id'].dataType.simpleString()}"
    out = None
    for i in range(blocks):
        rows = queries.filter(of == i).collect() if size else []
        block = Block(sorted(((r["item_id"], r["text"]) for r in rows), key=str))
        found = _ranked(docs, block, top) if block.ids else None
        if found is not None:
            names = spark.createDataFrame(list(enumerate(block.ids)), schema)
            part = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = part if out is None else out.unionByName(part)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def _ranked(docs: DataFrame, block: Block, top: int) -> DataFrame | None:
    bags = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_bags(block.vocabulary), _BAG),
        "bags", "zstd")
    total = bags.agg(F.count("*"), F.sum("n")).first()
    if not total[0]:
        return None
    weights = _weights(bags, block, total[0])
    share = F.expr(f"({LENGTH_SHARE}L * n * {total[0]}L) div {total[1]}L")
    classed = bags.filter(F.length("bag") > 0).withColumn("m", F.lit(LENGTH_BASE - LENGTH_SHARE) + share)
    for salt in count():
        keyed = classed.withColumns({
            "h1": F.xxhash64(F.lit(salt), "bag", "m"), "h2": F.xxhash64(F.lit(-1 - salt), "m", "bag")})
        classes = written(
            keyed.groupBy("h1", "h2", "bag", "m").agg(F.min("doc_id").alias("first")), "classes", "zstd")
        # Whole bags decide; a clash of their keys makes the next salt.
        if classes.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
    scored = classes.mapInArrow(
        _scores(block, weights, top), "item int, score long, first long, h1 long, h2 long")
    order = {"down": -F.col("score"), "last": F.col("first").isNull()}
    best = first_rows(scored.withColumns(order), ["item"], ["down", "last", "first", "h1", "h2"], top)
    best = written(best.select("item", "score", F.col("h1").alias("_1"), F.col("h2").alias("_2")), "best")
    # At most ``top`` classes of each item in the block.
    wanted = F.broadcast(best.select("_1", "_2").distinct())
    members = keyed.join(wanted, (keyed["h1"] == wanted["_1"]) & (keyed["h2"] == wanted["_2"]), "left_semi")
    members = members.select("doc_id", F.col("doc_id").isNull().alias("last"), "h1", "h2")
    members = first_rows(members, ["h1", "h2"], ["last", "doc_id"], top, rank="_r")
    rows = keyed_join(members, best, {"h1": "_1", "h2": "_2"}).withColumn("down", -F.col("score"))
    return first_rows(rows, ["item"], ["down", "last", "doc_id"], top).select(
        "item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _bags(vocabulary: dict[bytes, int]):
    """A document's number of terms, and its counts by ascending term number as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, bags = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                n, bag = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    bag.update(part)
                if n:
                    held = sorted((vocabulary[t], k) for t, k in bag.items() if t in vocabulary)
                    ids.append(doc_id)
                    sizes.append(n)
                    bags.append(np.array(held, np.int32).reshape(-1, 2).T.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())],
                names=["doc_id", "n", "bag"])

    return run


def _weights(bags: DataFrame, block: Block, n_docs: int) -> np.ndarray:
    """The weight of every term of the block, from the number of documents that hold it."""
    size = len(block.vocabulary)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column("bag").to_pylist():
                total[np.frombuffer(bag, np.int32).reshape(2, -1)[0]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    counts = bags.select("bag").mapInArrow(held, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(size, np.int64)
    for r in counts.collect():
        weights[r["term"]] = math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return weights


def _scores(block: Block, weights: np.ndarray, top: int):
    """The best classes of every item among those of a task."""
    of = np.array(block.terms, np.int64)
    gain = weights[of] * np.array(block.repeats, np.int64)
    starts = np.array(block.starts, np.int64)
    step = max(1, CELLS // max(len(of), len(weights)))
    last = np.iinfo(np.int64).max

    def best(parts: list[np.ndarray]) -> np.ndarray:
        """Rows ``item, -score, first, h1, h2``, the ``top`` least of each item."""
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        begin = np.searchsorted(rows[:, 0], rows[:, 0])
        return rows[np.arange(len(rows)) - begin < top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, least = [np.zeros((0, 5), np.int64)], 0, np.ones(len(starts), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                bags = [np.frombuffer(b, np.int32).reshape(2, -1) for b in batch.column("bag").to_pylist()]
                column = np.repeat(np.arange(len(bags)), [b.shape[1] for b in bags])
                term, tf = np.concatenate(bags, axis=1).astype(np.int64)
                m = batch.column("m").to_numpy(zero_copy_only=False)
                dense = np.zeros((len(weights), len(bags)), np.int64)
                dense[term, column] = (TF_SCALE * tf) // (TF_STEP * tf + LENGTH_STEP * m[column])
                score = np.add.reduceat(dense[of] * gain[:, None], starts, axis=0)
                item, col = np.nonzero(score >= least[:, None])
                first, h1, h2 = (
                    batch.column(c).fill_null(last).to_numpy(zero_copy_only=False)[col] for c in ("first", "h1", "h2"))
                kept.append(np.stack([item, -score[item, col], first, h1, h2], axis=1))
                size += len(item)
                if size > KEPT:
                    kept = [best(kept)]
                    size = 0
                    full = kept[0][top - 1:]
                    full = full[full[:, 0] == kept[0][:len(full), 0]]
                    least[full[:, 0]] = -full[:, 1]
        rows = best(kept)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[:, 0].astype(np.int32)), pa.array(-rows[:, 1]),
             pa.array(rows[:, 2], mask=rows[:, 2] == last), pa.array(rows[:, 3]), pa.array(rows[:, 4])],
            names=["item", "score", "first", "h1", "h2"])

    return run
