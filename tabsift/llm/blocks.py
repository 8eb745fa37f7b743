"""Sums of fixed-size arrays that tasks have filled, added up in bounded steps."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Cells of one row on the way.
BLOCK = 1 << 14
ROWS = "name string, block long, task long, data binary"


def packed(cells: np.ndarray) -> bytes:
    """Cells as bytes: whole numbers in 32 bits where they fit, and only those that are not zero
    where that is shorter."""
    if cells.dtype == np.int64 and np.abs(cells).max(initial=0) < 2**31:
        cells = cells.astype(np.int32)
    at = np.flatnonzero(cells)
    sparse = len(at) * (2 + cells.itemsize) < cells.nbytes
    body = at.astype(np.uint16).tobytes() + cells[at].tobytes() if sparse else cells.tobytes()
    return _HEAD.pack(cells.dtype.str.encode(), len(cells), len(at) if sparse else -1) + body


def unpacked(data: bytes) -> np.ndarray:
    kind, size, some = _HEAD.unpack_from(data)
    dtype = np.dtype(kind.decode())
    if some < 0:
        return np.frombuffer(data, dtype, size, _HEAD.size)
    cells = np.zeros(size, dtype)
    at = np.frombuffer(data, np.uint16, some, _HEAD.size)
    cells[at] = np.frombuffer(data, dtype, some, _HEAD.size + 2 * some)
    return cells


_HEAD = struct.Struct("<3sii")


def block_rows(arrays: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """A task's arrays as rows of at most ``BLOCK`` cells; all-zero blocks are left out."""
    task = TaskContext.get().partitionId()
    for name, array in arrays.items():
        flat = np.ascontiguousarray(array).reshape(-1)
        for i in range(0, len(flat), BLOCK):
            part = flat[i:i + BLOCK]
            if part.any():
                yield pd.DataFrame({"name": [name], "block": [i // BLOCK], "task": [task],
                                    "data": [packed(part)]})


def summed(rows: DataFrame, dtype: str, fan_in: int = 64) -> DataFrame:
    """``name, block, task, data`` summed over all tasks.

    At most ``fan_in`` rows of one block meet in a task, so steps are added as tasks grow: the
    number of steps is the logarithm of the number of tasks.
    """
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        # In the order of tasks, so that sums of fractions come out alike each time.
        parts = [unpacked(d) for d in pdf.sort_values("task")["data"]]
        total = np.zeros(len(parts[0]), dtype)
        for part in parts:
            total += part
        return pd.DataFrame({"name": pdf["name"][:1], "block": pdf["block"][:1],
                             "task": pdf["task"][:1] // fan_in, "data": [packed(total)]})

    tasks = max(1, rows.rdd.getNumPartitions())
    while True:
        group = (rows["task"] / fan_in).cast("long").alias("_g")
        rows = rows.groupBy("name", "block", group).applyInPandas(add, ROWS)
        if tasks <= fan_in:
            return rows
        tasks = -(-tasks // fan_in)


def gathered(rows: DataFrame, dtype: str, size: int) -> dict[str, np.ndarray]:
    """The arrays themselves on the driver: ``size`` cells for each name."""
    out: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():
        array = out.setdefault(r["name"], np.zeros(size, dtype))
        part = unpacked(r["data"])
        array[r["block"] * BLOCK:r["block"] * BLOCK + len(part)] += part
    return out
