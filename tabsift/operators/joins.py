"""The join of a large table with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(big: DataFrame, side: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join on ``{column of big: column of side}``; nulls in a key of several columns match.

    A side that comes out of an aggregate or a window is already partitioned by its key. Joined as
    it is, it gets no shuffle of its own, and the adaptive plan, which splits a hot key only between
    two shuffles, leaves a hot key whole. With the key as one struct both sides are shuffled for
    this join: the side is small, and a key with a third of all rows is split. A side that turns out
    tiny is still broadcast.
    """
    names = list(on.values())
    if how in ("left_semi", "left_anti"):
        # Only the keys matter, and fresh names tell them from the same columns of ``big``.
        side = side.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(names)])
        names = side.columns
    return big.join(side, _key(big, on) == _key(side, names), how)


def _key(df: DataFrame, columns) -> Column:
    return F.struct(*[df[c].alias(f"k{i}") for i, c in enumerate(columns)])
