"""Exact quantiles that never bring a whole group into one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer, which a group
holding a third of a huge table does not survive. Here a mergeable sketch first brackets each
quantile, then only the values inside the bracket are counted and ranked:

1. ``percentile_approx`` from ``p - margin`` to ``p + margin`` per group; its rank error is at most
   ``1 / accuracy`` of the group, so the bracket holds the wanted value. Other totals of the groups
   come from the same scan, and all of it goes through a small table;
2. rows below the bracket collapse into one count, rows inside are counted per value, both before
   the shuffle;
3. the bracket is cut at the sketch's own quantiles, so crowded values make short steps; the counts
   of the steps tell those that hold the wanted ranks, and only their values are ranked.

A group of n rows leaves about ``4 n / accuracy`` candidates, and a task ranks those of one step.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsift.operators.joins import keyed_join
from tabsift.session import estimated_bytes, scratch_path

ACCURACY = 10_000
#: Quantiles of the sketch from one end of a bracket to the other.
POINTS = 9
# Up to this estimated input size quantiles are counted without a bracket. The default is one plan
# for all sizes; a caller who knows that every group fits one task may ask for the other.
SMALL_INPUT = -1


def is_small(df: DataFrame, limit: int = SMALL_INPUT) -> bool:
    return estimated_bytes(df) <= limit


def _bracket_points(probs: list[float], accuracy: int) -> list[float]:
    margin = 2.0 / accuracy
    steps = [2 * i / (POINTS - 1) - 1 for i in range(POINTS)]
    return [min(1.0, max(0.0, p + margin * s)) for p in probs for s in steps]


def _keyed(df: DataFrame, by: list[str], columns: dict[str, Column]):
    keys = [f"k{i}" for i in range(len(by))]
    values = [f"v{i}" for i in range(len(columns))]
    data = df.select(
        *[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)],
        *[c.cast("double").alias(v) for c, v in zip(columns.values(), values)],
    )
    return data, keys, values


def _names(by: list[str], keys: list[str], columns: dict[str, Column]) -> list[Column]:
    measures = F.array(*[F.lit(m) for m in columns])
    return [
        *[F.col(k).alias(b) for b, k in zip(by, keys)],
        F.element_at(measures, F.col("mi") + 1).alias("measure"),
    ]


def between(low: Column, high: Column, part: Column) -> Column:
    """Interpolation that stays exact for equal neighbours, infinite ones among them."""
    return F.when((part == 0) | (low == high), low).otherwise(low + (high - low) * part)


def counted_quantiles(
    df: DataFrame, by: list[str], columns: dict[str, Column], probs: list[float]
) -> DataFrame:
    """``by..., measure, distinct, prob, value`` for inputs whose groups fit one task's sort.

    Every value is counted, then ranked by a running count.
    """
    data, keys, values = _keyed(df, by, columns)
    cells = F.array(*[
        F.struct(F.lit(mi).alias("mi"), F.col(v).alias("v")) for mi, v in enumerate(values)
    ])
    counted = (
        data.select(*keys, F.inline(cells)).filter(F.col("v").isNotNull())
        .groupBy(*keys, "mi", "v").agg(F.count(F.lit(1)).alias("m"))
    )
    group = W.partitionBy(*keys, "mi")
    ranked = counted.withColumns({
        "upto": F.sum("m").over(group.orderBy("v")),
        "n": F.sum("m").over(group),
    })

    def pick(p: float) -> Column:
        position = (F.col("n") - 1) * F.lit(p)
        low = F.min(F.when(F.col("upto") > F.floor(position), F.col("v")))
        high = F.min(F.when(F.col("upto") > F.ceil(position), F.col("v")))
        part = F.max(position - F.floor(position))
        return F.struct(F.lit(p).alias("prob"), between(low, high, part).alias("value"))

    picked = ranked.groupBy(*keys, "mi").agg(
        F.count(F.lit(1)).alias("distinct"), F.array(*[pick(p) for p in probs]).alias("q")
    )
    return picked.select(*_names(by, keys, columns), "distinct", F.inline("q"))


def _step(v: Column, points: list[Column]) -> Column:
    """The step of the bracket that a value lies in; it never falls as the value rises. Rows below
    the bracket are step -1."""
    return F.when(v.isNull(), -1).otherwise(reduce(add, [(p < v).cast("int") for p in points[1:-1]]))


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    columns: dict[str, Column],
    probs: list[float],
    accuracy: int = ACCURACY,
    small_input: int = SMALL_INPUT,
) -> DataFrame:
    """Interpolated quantiles, one row per group and measure: ``by..., measure, prob, value``.

    ``columns`` maps a measure name to a double expression; nulls do not count. A group without
    any value has no row.
    """
    if is_small(df, small_input):
        return counted_quantiles(df, by, columns, probs).drop("distinct")
    return totals_and_quantiles(df, by, columns, probs, [], accuracy)[1]


def totals_and_quantiles(
    df: DataFrame, by: list[str], columns: dict[str, Column], probs: list[float], totals: list[Column],
    accuracy: int = ACCURACY,
) -> tuple[DataFrame, DataFrame]:
    """Other aggregates of the groups, ``by..., totals...``, and their ``exact_quantiles``.

    Both need two scans together: the first one fills a table of one row per group.
    """
    keys = [f"k{i}" for i in range(len(by))]
    values = [f"v{i}" for i in range(len(columns))]
    points = F.array(*[F.lit(q) for q in _bracket_points(probs, accuracy)])
    bounds = [
        F.struct(F.count(c).alias("n"), F.percentile_approx(c, points, accuracy).alias("at")).alias(f"b_{v}")
        for v, c in zip(values, (c.cast("double") for c in columns.values()))
    ]
    path = scratch_path(df.sparkSession, "totals")
    df.groupBy(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)]).agg(*totals, *bounds).write.parquet(path)
    groups = df.sparkSession.read.parquet(path)
    named = groups.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *[
        f"`{c}`" for c in groups.columns if c not in keys and c not in [f"b_{v}" for v in values]])

    data, _, _ = _keyed(df, by, columns)
    if keys:
        side = groups.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[f"b_{v}" for v in values])
        data = keyed_join(data, side, {k: f"s_{k}" for k in keys}).drop(*[f"s_{k}" for k in keys])
        found = {v: (F.col(f"b_{v}.n"), [F.col(f"b_{v}.at")[i] for i in range(POINTS * len(probs))]) for v in values}
    else:
        # The one row's numbers go into the plan as they are.
        row = groups.first()
        found = {v: (F.lit(row[f"b_{v}"]["n"]).cast("long"), [F.lit(x) for x in row[f"b_{v}"]["at"] or []]) for v in values}

    entries = []
    for mi, v in enumerate(values):
        n, at = found[v]
        for pi, p in enumerate(probs if at else []):
            cuts = at[POINTS * pi:POINTS * (pi + 1)]
            # In a small group one rank is more than the margin, so all its values are candidates.
            few = n <= 4 * accuracy
            # A value below the bracket only matters as one more row to skip.
            inside = F.when(few | (F.col(v) >= cuts[0]), F.col(v))
            entries.append(
                F.when(
                    F.col(v).isNotNull() & (few | (F.col(v) <= cuts[-1])),
                    F.struct(
                        F.lit(mi).alias("mi"), F.lit(p).alias("prob"), n.alias("n"),
                        inside.alias("v"), _step(inside, cuts).alias("step"),
                    ),
                )
            )
    if not entries:
        entries = [F.lit(None).cast("struct<mi:int,prob:double,n:bigint,v:double,step:int>")]
    group = [*keys, "mi", "prob"]
    counted = (
        data.select(*keys, F.inline(F.array(*entries))).filter("mi IS NOT NULL")
        .groupBy(*group, "step", "v").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    )
    position = (F.col("n") - 1) * F.col("prob")
    below, above = F.floor(position), F.ceil(position)
    running = W.partitionBy(*group).orderBy("step")
    steps = counted.groupBy(*group, "step").agg(F.sum("m").alias("_held"), F.max("n").alias("n")).withColumn(
        "_upto", F.sum("_held").over(running))
    # The rows below the bracket, and the steps from the lower to the upper wanted rank.
    wanted = steps.filter(
        (F.col("step") < 0) | ((F.col("_upto") > below) & (F.col("_upto") - F.col("_held") <= above)))
    wanted = wanted.select(*[F.col(c).alias(f"w_{c}") for c in (*group, "step")],
                           (F.col("_upto") - F.col("_held")).alias("_before"))
    few_left = keyed_join(counted, wanted, {c: f"w_{c}" for c in (*group, "step")})
    within = W.partitionBy(*group, "step").orderBy("v")
    ranked = few_left.withColumn("upto", F.col("_before") + F.sum("m").over(within))
    picked = ranked.groupBy(*group, "n").agg(
        F.max(F.when(F.col("v").isNull(), F.col("upto"))).alias("skipped"),
        F.min(F.when(F.col("upto") > below, F.col("v"))).alias("low"),
        F.min(F.when(F.col("upto") > above, F.col("v"))).alias("high"),
    )
    outside = (F.coalesce(F.col("skipped"), F.lit(0)) > below) | F.col("high").isNull()
    value = F.when(
        outside, F.raise_error(F.lit("a quantile lies outside its bracket; raise the accuracy"))
    ).otherwise(between(F.col("low"), F.col("high"), position - below))
    return named, picked.select(*_names(by, keys, columns), "prob", value.alias("value"))
