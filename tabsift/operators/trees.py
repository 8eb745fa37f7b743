"""Tree documents held as VARIANT: conversion to and from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.functions.exprs import whole_json_or_fail


def as_tree(df: DataFrame, text: str, tree: str = "tree") -> DataFrame:
    """JSON text to a VARIANT column; text that is no JSON gives null, but text that may be too large
    for a VARIANT fails."""
    return df.withColumn(tree, whole_json_or_fail(F.col(text)))


def rows_to_tree(df: DataFrame, tree: str = "tree") -> DataFrame:
    """Each row becomes one object, a child of the table's ``rows`` root.

    The root itself is the returned DataFrame: its rows are the children, so no task holds them
    all.
    """
    return df.select(F.to_variant_object(F.struct("*")).alias(tree))


def tree_to_rows(
    df: DataFrame,
    tree: str,
    fields: dict[str, tuple[str, str]],
    explode_at: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Flatten trees to columns.

    ``fields`` maps a column to ``(path, type)``. With ``explode_at`` the array at that path gives
    one row per item, ``item_index`` says which, and paths that start with ``@`` are read from the
    item instead of the document (``@.name``).
    """
    kept = [F.col(k) for k in keep or []]
    data = df.select(*kept, F.col(tree).alias("_doc"))
    if explode_at:
        items = F.try_variant_get("_doc", explode_at, "array<variant>")
        data = data.select("*", F.posexplode(items).alias("item_index", "_item"))

    def read(path: str, dtype: str) -> Column:
        if path.startswith("@"):
            return F.try_variant_get("_item", "$" + path[1:], dtype)
        return F.try_variant_get("_doc", path, dtype)

    index = [F.col("item_index")] if explode_at else []
    return data.select(
        *kept, *index, *[read(path, dtype).alias(name) for name, (path, dtype) in fields.items()]
    )


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; null for text that is no JSON, but text that may be too large for
    a VARIANT fails, as all such texts would be alike."""
    return F.to_json(whole_json_or_fail(text))


def canonical_hash(text: Column) -> Column:
    """SHA-256 of the canonical form, equal for texts that differ in key order or spacing."""
    return F.sha2(canonical_json(text), 256)


def union_keys(df: DataFrame, text: str) -> DataFrame:
    """Keys of ragged JSON objects with how many rows carry each: ``key, rows``."""
    return (
        df.select(F.explode(F.array_distinct(F.json_object_keys(F.col(text)))).alias("key"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    )
