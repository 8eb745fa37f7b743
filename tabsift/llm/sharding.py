"""Shards by jump consistent hashing: no ring table, and a new shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsift.operators.joins import keyed_join

#: Fixed values of jump consistent hashing (Lamping and Veach): the generator's multiplier.
MULTIPLIER = 2862933555777941757
#: Ranges of checksums that a hot key is cut into.
PARTS = 256


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every unsigned 64-bit key.

    Each key draws the shard counts at which it would move; the last draw below ``shards`` is its
    place. The loop runs over draws, about log(shards) of them, with all keys at once.
    """
    state = keys.astype(np.uint64, copy=True)
    place = np.zeros(len(state), np.int64)
    here = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        place[going] = ahead[going]
        with np.errstate(over="ignore"):
            state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        here[going] = ahead[going]
        drawn = (state[going] >> np.uint64(33)).astype(np.float64) + 1
        ahead[going] = ((here[going] + 1) * (2147483648.0 / drawn)).astype(np.int64)
        going = going[ahead[going] < shards]
    return place


def jump_column(key: Column, shards: int) -> Column:
    """``key`` is a long; null goes where 0 goes."""
    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.coalesce(key, F.lit(0).cast("long")))


def shard(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", buckets: int = 256
) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    The key and the number of shards alone decide (law ``key``); ``grown_shard`` is the place with
    one shard more. Slots number a shard's rows from 0 in the order of key, checksum and size, null
    keys first. Rows equal in all three are interchangeable: they are counted before the shuffle
    and dealt out again afterwards, so a key that a third of all rows carry is one row on the way.
    The order of a shard is cut into ``buckets`` ranges of keys, and a key that fills more than one
    of them, as well as the null key, into ranges of checksums; each is numbered by itself and starts
    where the counts of the ranges before it end, so no task holds a whole shard or a hot key.

    Null and empty texts have size 1 and checksum 0. An empty table gives an empty table; other
    columns are not read.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).cast("long").alias("_key"),
        (F.length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"),
    )
    if shards < 1 or buckets < 1:
        raise ValueError("at least one shard and one bucket are needed")
    edges = []
    if buckets > 1:
        cuts = [i / buckets for i in range(1, buckets)]
        ids = docs.select(F.col(key).cast("double").alias("_key"))
        edges = [int(e) for e in ids.approxQuantile("_key", cuts, 1 / (4 * buckets))]
    counted = rows.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("_n"))
    placed = counted.withColumns({
        "shard": jump_column(F.col("_key"), shards),
        "grown_shard": jump_column(F.col("_key"), shards + 1),
        "_bucket": _bucket(F.col("_key"), F.col("text_crc32"), edges),
    })
    # At most shards x buckets x (1 + PARTS / 2) rows, whatever the input.
    totals = placed.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_total"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        F.col("shard").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"),
    )
    within = (
        W.partitionBy("shard", "_bucket").orderBy("_key", "text_crc32", "size")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    numbered = placed.withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    joined = keyed_join(numbered, F.broadcast(starts), {"shard": "_s", "_bucket": "_b"})
    return joined.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(
            F.col("_start") + F.col("_first"), F.col("_start") + F.col("_first") + F.col("_n") - 1
        )).alias("slot"),
        "grown_shard",
    )


def _bucket(key: Column, crc: Column, edges: list[int]) -> Column:
    """The range of a row: rises with its key and, within a key that several edges name, its checksum.

    Null keys come first.
    """
    part = F.floor(crc / (2**32 / PARTS))
    if not edges:
        return F.lit(0).cast("long")
    known = sorted(set(edges))
    below = F.aggregate(_longs(known), F.lit(0), lambda n, e: n + (e < key).cast("int"))
    hot = key.isin([e for e in known if edges.count(e) > 1])
    # A hot key is the last of its range.
    return F.when(key.isNull(), part).otherwise(
        (below + 1) * (2 * PARTS) + F.when(hot, PARTS + part).otherwise(0)).cast("long")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])
