"""Per-column statistics, distinct counts and most frequent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.functions.tags import NUMERIC_TAGS, tag_of
from tabsift.operators.quantiles import (
    SMALL_INPUT, counted_quantiles, exact_quantiles, is_small,
)


# Texts up to this length are counted as they are, longer ones by digest.
HEAD = 128


def _as_key(field: T.StructField) -> Column:
    """A value as text, equal values giving equal text; empty text is no value."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c)
    return F.nullif(c.cast("string"), F.lit(""))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n`` for every value of every column, in one shuffle.

    Counts combine before the shuffle, so a value that fills a third of a column costs one row
    per task.
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), _as_key(f).alias("value")) for f in fields
    ])
    return (
        df.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cardinality(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """``column, distinct`` over raw values; long text travels as its digest."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    if approx:
        row = df.agg(*[
            F.approx_count_distinct(_as_key(f)).alias(f"d{i}") for i, f in enumerate(fields)
        ])
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(f.name).alias("column"), F.col(f"d{i}").alias("distinct"))
            for i, f in enumerate(fields)
        ])))
    texts = [f for f in fields if tag_of(f.dataType) not in NUMERIC_TAGS]
    values = _distinct_numbers(df.select(*[f"`{f.name}`" for f in fields]))
    if texts:
        cells = F.array(*[
            F.struct(F.lit(f.name).alias("column"), _digest(_as_key(f)).alias("value"))
            for f in texts
        ])
        values = values.unionAll(
            df.select(F.inline(cells)).filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("column").agg(F.count(F.lit(1)).alias("d"))
        )
    # A column without any value still reports 0.
    names = F.array(*[F.lit(f.name) for f in fields])
    every = df.agg(F.count(F.lit(1)).alias("_")).select(F.explode(names).alias("column"))
    return every.join(values, "column", "left").select(
        "column", F.coalesce("d", F.lit(0)).alias("distinct")
    )


def _text_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, head, digest, n``: values counted under their start and, where that is not all
    of it, the digest of the whole. Long texts are told apart without shuffling them."""
    fields = [f for f in df.schema if f.name in columns]
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), _as_key(f).alias("value")) for f in fields
    ])
    return (
        df.select(F.inline(cells)).filter(F.col("value").isNotNull())
        .groupBy("column", *_head_and_digest()).agg(F.count(F.lit(1)).alias("n"))
    )


def _head_and_digest() -> list[Column]:
    long = F.length("value") > HEAD
    return [
        F.substring("value", 1, HEAD).alias("head"),
        F.when(long, F.sha2("value", 256)).alias("digest"),
    ]


def _top_texts(df: DataFrame, counts: DataFrame, columns: list[str], top_n: int) -> DataFrame:
    """``column, rank, value, n`` of the most frequent values; equal counts rank by value.

    Long texts among the winners, and all that tie with the last one by count and start, are looked
    up again and ranked by the whole text.
    """
    by_column = W.partitionBy("column")
    start = by_column.orderBy(F.col("n").desc(), F.col("head").asc())
    ranked = counts.withColumn("rank", F.rank().over(start)).filter(F.col("rank") <= top_n)
    fields = [
        f for f in df.schema if f.name in columns
        and not isinstance(f.dataType, (T.BooleanType, T.DatetimeType, T.TimestampNTZType))
    ]
    if not fields:
        return ranked.select("column", "rank", F.col("head").alias("value"), "n")
    wanted = ranked.filter(F.col("digest").isNotNull()).select("column", "digest")
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), _as_key(f).alias("value")) for f in fields
    ])
    texts = (
        df.select(F.inline(cells)).filter(F.length("value") > HEAD)
        .select("column", F.sha2("value", 256).alias("digest"), "value")
        .join(wanted, ["column", "digest"])
        .groupBy("column", "digest").agg(F.first("value").alias("whole"))
    )
    whole = ranked.join(texts, ["column", "digest"], "left").select(
        "column", F.coalesce("whole", "head").alias("value"), "n"
    )
    order = by_column.orderBy(F.col("n").desc(), F.col("value").asc())
    return whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n).select(
        "column", "rank", "value", "n"
    )


def _distinct_numbers(df: DataFrame) -> DataFrame:
    """``column, d`` for the numeric columns, counted in their own types: text costs more."""
    out = df.sparkSession.createDataFrame([], "column string, d bigint")
    numbers = [f for f in df.schema if tag_of(f.dataType) in NUMERIC_TAGS and not isinstance(f.dataType, T.DecimalType)]
    if numbers:
        def only(f, whole: bool, dtype: str) -> Column:
            fits = isinstance(f.dataType, T.IntegralType) == whole
            return (F.col(f"`{f.name}`") if fits else F.lit(None)).cast(dtype)

        # One scan for both types.
        cells = F.array(*[
            F.struct(F.lit(i).alias("i"), only(f, True, "bigint").alias("w"), only(f, False, "double").alias("v"))
            for i, f in enumerate(numbers)
        ])
        names = F.array(*[F.lit(f.name) for f in numbers])
        out = out.unionAll(
            df.select(F.inline(cells)).filter("w IS NOT NULL OR v IS NOT NULL")
            .groupBy("i", "w", "v").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("i").agg(F.count(F.lit(1)).alias("d")).select(names[F.col("i")].alias("column"), "d")
        )
    decimals = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    if decimals:
        out = out.unionAll(
            value_counts(df, decimals).groupBy("column").agg(F.count(F.lit(1)).alias("d"))
        )
    return out


def _digest(text: Column) -> Column:
    return F.when(F.length(text) <= 64, text).otherwise(F.sha2(text, 256))


def _moments(df: DataFrame) -> tuple[list[Column], Column]:
    """Aggregates for the counts and moments of every column, and the rows to make of them."""
    aggregates, cells = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        filled = F.nullif(c, F.lit("")) if isinstance(f.dataType, T.StringType) else c
        aggregates.append(F.count(filled).alias(f"count{i}"))
        numeric = tag_of(f.dataType) in NUMERIC_TAGS
        if numeric:
            number = c.cast("double")
            aggregates += [
                F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}"),
                F.avg(number).alias(f"mean{i}"), F.stddev_pop(number).alias(f"stddev{i}"),
            ]
        cells.append(F.struct(
            F.lit(f.name).alias("column"),
            F.lit(tag_of(f.dataType)).alias("type"),
            F.col(f"count{i}").alias("count"),
            (F.col("rows") - F.col(f"count{i}")).alias("nulls"),
            *[
                (F.col(f"{m}{i}") if numeric else F.lit(None).cast("double")).alias(m)
                for m in ("min", "max", "mean", "stddev")
            ],
        ))
    return aggregates, F.inline(F.array(*cells))


def _column_moments(df: DataFrame) -> DataFrame:
    """Counts and moments of every column in one scan; one row shuffled per task."""
    aggregates, cells = _moments(df)
    return df.agg(*aggregates).select(cells)


def _medians(df: DataFrame, numeric: list[str], small: bool, distinct: bool) -> DataFrame:
    """``column, median, d`` for the numeric columns."""
    values = {n: F.col(f"`{n}`").cast("double") for n in numeric}
    name = F.col("measure").alias("column")
    if small and not _beyond_double(df, numeric):
        ranked = counted_quantiles(df, [], values, [0.5])
        return ranked.select(name, F.col("value").alias("median"), F.col("distinct").alias("d"))
    medians = exact_quantiles(df, [], values, [0.5], small_input=-1)
    medians = medians.select(name, F.col("value").alias("median"))
    if not distinct:
        return medians.withColumn("d", F.lit(None).cast("bigint"))
    return medians.join(_distinct_numbers(df), "column")


def _beyond_double(df: DataFrame, numeric: list[str]) -> bool:
    """Whether a decimal column may hold values a double cannot tell apart."""
    return any(
        isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 15
        for f in df.schema if f.name in numeric
    )


def summary_numeric(df: DataFrame, small_input: int = SMALL_INPUT) -> DataFrame:
    """``summary`` without distinct counts and top values."""
    moments = _column_moments(df)
    numeric = [f.name for f in df.schema if tag_of(f.dataType) in NUMERIC_TAGS]
    if not numeric:
        return moments.withColumn("median", F.lit(None).cast("double"))
    medians = _medians(df, numeric, is_small(df, small_input), distinct=False).drop("d")
    return moments.join(medians, "column", "left")


def summary(
    df: DataFrame, top_n: int = 10, approx: bool = False, small_input: int = SMALL_INPUT
) -> DataFrame:
    """One row per column.

    ``column, position, type, count, nulls, distinct, min, max, mean, median, stddev, top``.
    Null and empty text count as null. The numeric fields are filled for numeric columns (the
    standard deviation is the population one), ``top`` for the others. Numbers and texts are
    counted apart, so numbers never travel as text. ``approx`` estimates the distinct counts.
    """
    fields = list(df.schema)
    numeric = [f.name for f in fields if tag_of(f.dataType) in NUMERIC_TAGS]
    texts = [f.name for f in fields if f.name not in numeric]
    out = _column_moments(df)
    facts = [_medians(df, numeric, is_small(df, small_input), distinct=not approx)] if numeric else []
    if texts:
        counts = _text_counts(df, texts)
        # Summing over n keeps the column in the plan, so both uses of the counts share a shuffle.
        facts.append(counts.groupBy("column").agg(
            F.lit(None).cast("double").alias("median"),
            F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("d"),
        ))
        top = _top_texts(df, counts, texts, top_n).groupBy("column").agg(
            F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top")
        )
        out = out.join(top, "column", "left")
    else:
        out = out.withColumn("top", F.lit(None).cast("array<struct<rank:int,value:string,n:bigint>>"))
    known = facts[0] if len(facts) == 1 else facts[0].unionAll(facts[1])
    if approx:
        estimate = cardinality(df, approx=True)
        known = known.drop("d").join(estimate.withColumnRenamed("distinct", "d"), "column", "right")
    names = F.array(*[F.lit(f.name) for f in fields])
    shown = F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count")))
    empty = F.array().cast("array<struct<value:string,count:bigint>>")
    return out.join(known, "column", "left").select(
        "column", F.array_position(names, F.col("column")).alias("position"), "type",
        "count", "nulls", F.coalesce("d", F.lit(0)).alias("distinct"),
        "min", "max", "mean", "median", "stddev",
        F.when(F.col("type").isin(*NUMERIC_TAGS), None)
        .otherwise(F.coalesce(shown, empty)).alias("top"),
    )
