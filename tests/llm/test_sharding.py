import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.llm.sharding import _bucket, jump, shard


def walk(key, shards):
    """Jump consistent hashing for one key, in plain integers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 2000, dtype=np.uint64)
    for shards in (1, 2, 8, 9, 100):
        assert jump(keys, shards).tolist() == [walk(int(k), shards) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20000, dtype=np.uint64)
    a, b = jump(keys, 8), jump(keys, 9)
    assert set(b[a != b]) == {8}
    assert 0.09 < (a != b).mean() < 0.13
    assert np.bincount(a).min() > 0.9 * 20000 / 8


def plain(rows):
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = (doc_id or 0) % 2**64
        out.append((doc_id, len(data) + 1, zlib.crc32(data), walk(key, 8), walk(key, 9)))
    out.sort(key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    slots, result = {}, []
    for r in out:
        slots[r[3]] = slots.get(r[3], -1) + 1
        result.append((r[0], r[1], r[2], "key", r[3], slots[r[3]], r[4]))
    return sorted(result, key=str)


@pytest.mark.parametrize("buckets", [1, 7, 256])
def test_shard_against_brute_force(spark, buckets):
    rows = [(i, f"text {i} é") for i in range(-50, 300)]
    rows += [(None, "a"), (None, None), (7, "")] + [(5, "same")] * 40 + [(6, "x" * 100000)]
    df = spark.createDataFrame(
        [(d, t, "en", 1, "k") for d, t in rows],
        "doc_id long, text string, shard string, slot int, law string")
    got = shard(df, buckets=buckets).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_a_hot_key_is_cut_by_checksum(spark):
    rows = [(7, f"text {i}") for i in range(600)] + [(None, f"none {i}") for i in range(300)]
    rows += [(i, "x") for i in range(-100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(df, buckets=16).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    edges = [3, 7, 7, 7, 50]
    placed = df.select("doc_id", "text", _bucket(F.col("doc_id"), F.crc32(F.col("text").cast("binary")), edges).alias("b"))
    seen = {}
    for r in placed.collect():
        seen.setdefault(r.b, []).append(r.doc_id)
    assert max(len(v) for k, v in seen.items() if 7 in v) < 20 and max(len(v) for v in seen.values() if None in v) < 20
    order = [r.b for r in placed.orderBy("doc_id", F.crc32(F.col("text").cast("binary"))).collect()]
    assert order == sorted(order)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard(df).columns == [
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert shard(df).count() == 0
    with pytest.raises(ValueError):
        shard(df, shards=0)
