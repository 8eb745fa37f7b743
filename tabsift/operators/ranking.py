"""Ordered selections per group that stay safe when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.operators.joins import keyed_join
from tabsift.session import reliable_checkpoint

SALTS = 32


def latest(df: DataFrame, keys: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per group, found by a combining aggregate."""
    pick = F.max_by(F.struct(*fields), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, "_p.*")


def first_rows(
    df: DataFrame, keys: list[str], order: list[str], limit: int, rank: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """The first ``limit`` rows per group with their rank.

    Rows are cut to the limit in every task before any shuffle, then per salted part of the
    group, and only those few meet in one task.
    """
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    part = W.partitionBy(*keys, "_salt").orderBy(*ordering)
    cut = salted.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= limit)
    whole = W.partitionBy(*keys).orderBy(*ordering)
    return (
        cut.drop("_salt", rank)
        .withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= limit)
    )


def group_edges(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """``keys..., edge``: the ``limit``-th position of every group that has one."""
    full = first_rows(df.select(*keys, *order), keys, order, limit).filter(F.col("rank") == limit)
    return full.select(*keys, F.struct(*order).alias("edge"))


def rows_after(df: DataFrame, edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows behind their group's edge, with the other columns of ``edges``.

    Rows are only compared with the edge, so a huge group is never sorted in one task.
    """
    extra = [c for c in edges.columns if c not in (*keys, "edge")]
    side = edges.select(
        *[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], F.col("edge").alias("_edge"), *extra
    )
    joined = keyed_join(df, side, {k: f"_e{i}" for i, k in enumerate(keys)})
    return joined.filter(F.struct(*order) > F.col("_edge")).select(df["*"], *extra)


def rows_beyond(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Every row after the first ``limit`` of its group. ``order`` must be unique in a group."""
    return rows_after(df, group_edges(df, keys, order, limit), keys, order)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the earliest; a combining aggregate, so repeats cost no shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, "_p.*").select(*df.columns)


#: Time cells that a lifetime is cut into, so that one key's rows meet in many tasks.
CELLS = 64


def claims(df: DataFrame, keys: list[str], ts: str, seq: str, lifetime: Column) -> DataFrame:
    """The rows that win their key: the first, then the first one after its lifetime, and so on.

    Every row points to the row that would win next after it. The winners are what the first row
    reaches; pointers double in length each round, so the number of rounds is the logarithm of the
    lifetimes that a key spans, and the usual key, which spans one, needs none. Rows of a key meet
    only with those of their cell of time, and those of equal time are one row.
    """
    firsts = first_wins(df, keys, [ts, seq])
    numeric = isinstance(df.schema[ts].dataType, T.NumericType)

    def number(c: Column) -> Column:
        return c.cast("double") if numeric else F.unix_micros(c.cast("timestamp")).cast("double")

    at = df.select(*keys, number(F.col(ts)).alias("_t"), number(F.col(ts) + lifetime).alias("_free")).groupBy(
        *keys, "_t").agg(F.min("_free").alias("_free"))
    spans = at.groupBy(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)]).agg(
        F.min(F.struct("_t", "_free")).alias("_first"), F.max("_t").alias("_last"))
    on = {k: f"_w{i}" for i, k in enumerate(keys)}
    long = spans.filter(F.col("_last") >= F.col("_first._free"))
    width = F.greatest((F.col("_first._free") - F.col("_first._t")) / CELLS, F.lit(1e-9)).alias("_width")
    rows = keyed_join(at, long.select(*on.values(), F.col("_first._t").alias("_from"), width), on).drop(*on.values())
    rows = reliable_checkpoint(rows)
    if rows.isEmpty():
        return firsts
    steps = reliable_checkpoint(_next_after(rows, keys))
    reached = reliable_checkpoint(rows.filter(F.col("_t") == F.col("_from")).select(*keys, "_t"))
    new = reached
    while True:
        # What is reached so far takes the step of the present length.
        new = reliable_checkpoint(_follow(reached, steps, keys, "_t"))
        if new.isEmpty():
            break
        reached = reliable_checkpoint(reached.unionByName(new))
        steps = reliable_checkpoint(_follow(steps.withColumnRenamed("_t", "_start"), steps, keys, "_next").select(
            *keys, F.col("_start").alias("_t"), F.col("_t").alias("_next")))
    timed = first_wins(df.withColumn("_t", number(F.col(ts))), [*keys, "_t"], [ts, seq])
    winners = reached.select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], F.col("_t").alias("_wt"))
    later = keyed_join(timed, winners, on | {"_t": "_wt"}).select(*df.columns)
    short = keyed_join(firsts, long.select(*on.values()), on, "left_anti")
    return short.unionByName(later)


def _follow(rows: DataFrame, steps: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The rows moved from ``place`` by one step, as ``_t``; those without one are left out."""
    side = steps.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("_t").alias("_st"),
                        F.col("_next").alias("_to"))
    joined = keyed_join(rows, side, {k: f"_s{i}" for i, k in enumerate(keys)} | {place: "_st"})
    kept = [c for c in rows.columns if c not in (*keys, place)]
    return joined.select(*keys, *kept, F.col("_to").alias("_t"))


def _next_after(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., _t, _next``: for every time the first one that is not before its ``_free``."""
    def cell(t: str) -> Column:
        return F.floor((F.col(t) - F.col("_from")) / F.col("_width")).alias("_cell")

    here = rows.select(*keys, cell("_t"), F.col("_t").alias("_at"), F.col("_t").alias("_target"),
                       F.lit(None).cast("double").alias("_t"))
    asked = rows.select(*keys, cell("_free"), F.col("_free").alias("_at"), F.lit(None).cast("double").alias("_target"), "_t")
    both = here.unionByName(asked)
    within = W.partitionBy(*keys, "_cell").orderBy("_at").rangeBetween(0, W.unboundedFollowing)
    found = both.withColumn("_in", F.min("_target").over(within)).filter("_t IS NOT NULL")
    # One row per cell that holds a time or is asked for.
    beyond = W.partitionBy(*keys).orderBy("_cell").rowsBetween(1, W.unboundedFollowing)
    cells = both.groupBy(*keys, "_cell").agg(F.min("_target").alias("_head")).withColumn(
        "_beyond", F.min("_head").over(beyond)).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"), "_beyond")
    joined = keyed_join(found, cells, {k: f"_k{i}" for i, k in enumerate(keys)} | {"_cell": "_c"})
    return joined.select(*keys, "_t", F.coalesce("_in", "_beyond").alias("_next")).filter("_next IS NOT NULL")
