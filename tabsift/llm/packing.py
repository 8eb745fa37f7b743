"""Best-fit packing of documents into sequences, with lower bounds that certify the result."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.bytebpe import encoder
from tabsift.llm.common import texts_of, written

CAPACITY = 1024
END = 2
#: About the number of pieces that one task packs at a time.
PART_ROWS = 50_000
ROUNDS = 4

PIECES = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
    ("length", pa.int64()), ("ids_crc32", pa.int64()),
])
_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", part long, bin long, offset long, fill long, bins long, bound long"


def cut(ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    """A document's ids in pieces; all but the first are full."""
    first = len(ids) % capacity or capacity
    return [ids[:first], *(ids[i:i + capacity] for i in range(first, len(ids), capacity))]


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``uid, doc_id, piece, start, length, ids_crc32``: the token pieces of every document.

    A document is its token ids and then ``end``; a null text is empty, so a piece of one id.
    Whole texts are tokenized, one at a time, and only sizes and checksums go on.
    """
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), texts_of(batch, "_t")):
                ids, start = np.append(encode(t), np.uint32(end)).astype("<u4"), 0
                for number, piece in enumerate(cut(ids, capacity)):
                    out.append((uid, doc, number, start, len(piece), zlib.crc32(piece.tobytes())))
                    start += len(piece)
                    uid += 1
            columns = zip(*out) if out else [[]] * len(PIECES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

    return rows.mapInArrow(run, _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill.

    Open bins are kept by the room they have left; a bit per amount of room finds the tightest
    that fits in one step.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, fills = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left -= size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of ``sizes`` has fewer bins.

    A dual feasible function maps sizes so that what fits a bin still does; the mapped sizes' sum,
    in bins, is a bound. Tried are the identity, the rounding functions u(k), which keep multiples
    of capacity / (k + 1) and round the rest down, the threshold functions, which raise sizes over
    capacity - t to a whole bin and drop those below t, and each threshold followed by rounding.
    """
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    mapped = [x]
    for t in range(1, capacity // 2 + 1):
        mapped.append(np.where(x > capacity - t, capacity, np.where(x < t, 0, x)))
    family = np.array(mapped)
    best = max(best, int((-(-(family @ counts) // capacity)).max()))
    # u(k) in units of 1 / (k * capacity): k x where (k + 1) x is a multiple of the capacity,
    # else capacity * floor((k + 1) x / capacity).
    for k in range(1, 33):
        scaled = (k + 1) * family
        rounded = np.where(scaled % capacity == 0, k * family, capacity * (scaled // capacity))
        best = max(best, int((-(-(rounded @ counts) // (k * capacity))).max()))
    return best


def _packed_parts(rows: DataFrame, parts: int, salt: int, capacity: int, first: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit(sizes, capacity)
        return pdf.assign(
            part=first + key[0], bin=bins, offset=offsets, fill=fills[bins], bins=len(fills),
            bound=lower_bound(sizes, capacity))

    part = F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(parts)).alias("_part")
    return rows.select(*PIECES.names).groupBy(part).applyInPandas(run, _PACKED)


def packed(
    cut_up: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS,
) -> DataFrame:
    """``pieces`` with ``sequence_id, offset, certified``.

    Full pieces are sequences of their own. The rest is dealt into partitions of about
    ``part_rows`` pieces by a hash, and each is packed by best-fit decreasing. A partition whose
    number of bins equals its lower bound is certified: it cannot be packed better. From those with
    a gap, the pieces of all bins that are not full are brought together, dealt anew and packed
    again, while that needs fewer bins than before, at most ``rounds`` times. ``certified`` tells
    whether a sequence's last partition reached its bound. Each round goes through a table in the
    shared folder, and only counts come to the driver.
    """
    whole = cut_up.filter(F.col("length") >= capacity).select(
        *PIECES.names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    shorts = cut_up.filter(F.col("length") < capacity)
    parts = max(1, -(-shorts.count() // part_rows))
    first = 0
    done = written(_packed_parts(shorts, parts, 0, capacity, first), "packed")
    for salt in range(1, rounds + 1):
        first += parts
        pool = done.filter((F.col("bins") > F.col("bound")) & (F.col("fill") < capacity))
        bins = F.count_distinct(F.struct("part", "bin"))
        size, before = pool.agg(F.count("*"), bins).first()
        if size == 0:
            break
        # The second time the same pieces meet in one partition nothing can change.
        parts = -(-size // part_rows)
        again = written(_packed_parts(pool, parts, salt, capacity, first), "packed")
        after = again.agg(bins).first()[0]
        if after >= before:
            break
        kept = done.filter(~((F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)))
        done = kept.unionByName(again)
        if parts == 1:
            break
    return whole.unionByName(done.select(
        *PIECES.names, (F.col("part") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset",
        (F.col("bins") == F.col("bound")).alias("certified")))


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified`` per piece.

    ``vocabulary`` is the path of a ``tokenizers`` file. Null texts are empty documents of one id.
    Repeated rows are documents of their own, also where their ids are equal or null. An empty
    table gives an empty table; other columns are not read.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    cut_up = written(pieces(docs, vocabulary, capacity, end), "pieces")
    return packed(cut_up, capacity, part_rows).drop("uid")
