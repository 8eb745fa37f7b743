"""Group-by analysis."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.errors import invalid
from tabsift.operators.infer import to_number
from tabsift.operators.quantiles import SMALL_INPUT, exact_quantiles, is_small, totals_and_quantiles

# The aggregate names.
AGGREGATES = ("sum", "count", "avg", "min", "max", "median")


def group_by_problems(df: DataFrame, by: list[str], agg: dict[str, list[str]]) -> list[str]:
    problems = [] if by else ["name at least one column to group by"]
    problems += [f"cannot group by {c!r}: no such column" for c in by if c not in df.columns]
    problems += [f"cannot aggregate {c!r}: no such column" for c in agg if c not in df.columns]
    problems += [
        f"{fn!r} is no aggregate" for fns in agg.values() for fn in fns
        if fn not in AGGREGATES
    ]
    return problems


def as_number(df: DataFrame, name: str) -> Column:
    """A value as a double; what is no number is skipped by the numeric aggregates."""
    value, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return to_number(value)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def _aggregate(df: DataFrame, name: str, fn: str) -> Column:
    value = as_number(df, name)
    return {
        "sum": F.coalesce(F.sum(value), F.lit(0.0)),
        "count": F.count(F.col(f"`{name}`")),
        "avg": F.coalesce(F.avg(value), F.lit(0.0)),
        "min": F.min(value),
        "max": F.max(value),
    }[fn].alias(f"{name}_{fn}")


def group_by(
    df: DataFrame, by: list[str], agg: dict[str, list[str]], small_input: int = SMALL_INPUT
) -> DataFrame:
    """Aggregate numeric readings of columns per group; a null key is a group of its own.

    A group shows only if one of the aggregated columns has a value in it. ``sum`` and ``avg`` of
    nothing are 0, the others null. All but ``median`` combine before the shuffle; medians go through
    ``exact_quantiles``.
    """
    problems = group_by_problems(df, by, agg)
    if problems:
        raise invalid(problems)
    keys = [F.col(f"`{b}`") for b in by]
    if not agg:
        return df.select(*keys).limit(0)
    present = reduce(or_, [F.col(f"`{c}`").isNotNull() for c in agg])
    data = df.select(*dict.fromkeys([*by, *agg])).filter(present)
    pairs = [(c, fn) for c, fns in agg.items() for fn in dict.fromkeys(fns)]
    medians = [c for c, fn in pairs if fn == "median"]
    if not medians:
        return data.groupBy(*keys).agg(*[_aggregate(data, c, fn) for c, fn in pairs])

    plain = [_aggregate(data, c, fn) for c, fn in pairs if fn != "median"]
    values = {c: as_number(data, c) for c in medians}
    if is_small(data, small_input):
        totals = data.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
        middle = exact_quantiles(data, by, values, [0.5], small_input=small_input)
    else:
        # One scan for the totals and where the medians lie, one for the medians.
        totals, middle = totals_and_quantiles(data, by, values, [0.5], plain)
    wide = middle.groupBy(*keys).agg(*[
        F.max(F.when(F.col("measure") == c, F.col("value"))).alias(f"{c}_median") for c in medians
    ])
    side = wide.select(
        *[F.col(f"`{b}`").alias(f"_k{i}") for i, b in enumerate(by)],
        *[f"{c}_median" for c in medians],
    )
    match = reduce(
        and_, [totals[f"`{b}`"].eqNullSafe(side[f"_k{i}"]) for i, b in enumerate(by)]
    )
    return totals.join(side, match, "left").select(
        *[totals[f"`{b}`"] for b in by], *[f"`{c}_{fn}`" for c, fn in pairs]
    )
