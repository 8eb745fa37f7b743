import numpy as np
import pytest

from tabsift.llm.blocks import block_rows, gathered, packed, summed, unpacked


@pytest.mark.parametrize("cells", [
    np.zeros(5, np.int64), np.arange(16384), np.array([2**40, 0, -1]), np.array([0.5, 0, 1e300]),
    np.eye(1, 16384, 16383, dtype=np.int64)[0], np.arange(3, dtype=np.float32), np.zeros(0, np.int32),
])
def test_packing(cells):
    back = unpacked(packed(cells))
    assert len(back) == len(cells) and (back == cells).all()
    assert len(packed(cells)) <= cells.nbytes + 11


@pytest.mark.parametrize("fan_in", [2, 64])
def test_sums_over_many_tasks(spark, fan_in):
    def fill(batches):
        total = np.zeros(40_000, np.int64)
        for pdf in batches:
            np.add.at(total, pdf["id"].to_numpy() % 40_000, pdf["id"].to_numpy())
        yield from block_rows({"a": total, "b": (total > 0).astype(np.int64)})

    rows = spark.range(0, 100_000, 1, 13).mapInPandas(fill, "name string, block long, task long, data binary")
    got = gathered(summed(rows, "int64", fan_in), "int64", 40_000)
    ids = np.arange(100_000)
    assert (got["a"] == np.bincount(ids % 40_000, ids, 40_000)).all()
    assert got["b"].min() >= 1
