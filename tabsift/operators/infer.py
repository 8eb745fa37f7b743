"""Column types of text data, found in one aggregate pass and applied with casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.functions.tags import tag_of

_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"
# Words that read as booleans.
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no")


# A failed cast costs many times a failed pattern, so casts only see text that passed one.
_FITS_INTEGER, _FITS_NUMBER, _FITS_BOOLEAN, _FITS_LONG = 1, 2, 4, 8


def _digits(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(" \t+-")))


def _fits(text: Column) -> Column:
    """What a non-empty value can be read as, as a bit set; null for an empty one."""
    is_long = (_digits(text) <= 18) | text.try_cast("bigint").isNotNull()
    whole = _FITS_INTEGER + _FITS_NUMBER
    bits = F.when(text.isin("0", "1"), _FITS_BOOLEAN).otherwise(0) + F.when(
        is_long, _FITS_LONG).otherwise(0)
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(text.rlike(_INTEGER), bits + whole)
        .when(text.rlike(_NUMBER), _FITS_NUMBER)
        .when(F.lower(text).isin(*BOOLEAN_WORDS), _FITS_BOOLEAN)
        .otherwise(0)
    )


def value_tag(text: Column) -> Column:
    """Tightest tag of one text value; null for an empty one."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), None)
        .when(text.rlike(_INTEGER), "integer")
        .when(text.rlike(_NUMBER), "number")
        .when(F.lower(text).isin(*BOOLEAN_WORDS), "boolean")
        .otherwise("string")
    )


def to_number(text: Column) -> Column:
    """Text as a double, null where it is no number."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def column_facts(df: DataFrame, text: list[str], by: str | None = None) -> DataFrame:
    """``column, fits, digits`` of text columns, for each value of ``by`` where it is given.

    One scan; a row of numbers per group and task is shuffled. The facts of two sets of rows merge.
    """
    kept = [by] if by else []
    facts = df.select(
        *kept, *[_fits(F.col(f"`{n}`")).alias(f"fits{i}") for i, n in enumerate(text)],
        *[_digits(F.col(f"`{n}`")).alias(f"digits{i}") for i, n in enumerate(text)],
    ).groupBy(*kept).agg(
        *[F.bit_and(f"fits{i}").alias(f"fits{i}") for i in range(len(text))],
        *[F.max(f"digits{i}").alias(f"digits{i}") for i in range(len(text))],
    )
    found = F.array(*[F.struct(
        F.lit(n).alias("column"), F.col(f"fits{i}").alias("fits"), F.col(f"digits{i}").alias("digits"),
    ) for i, n in enumerate(text)])
    return facts.select(*kept, F.inline(found))


def merged_types(facts: DataFrame, text: list[str]) -> dict[str | None, str]:
    """The types to cast to, from the facts of several sets of rows; null stands for sets without."""
    merged = facts.filter(F.col("column").isin(*text) | F.col("column").isNull()).groupBy("column").agg(
        F.bit_and("fits").alias("fits"), F.max("digits").alias("digits"))
    return {r["column"]: r["cast_to"] for r in _typed(merged).select("column", "cast_to").collect()}


def _typed(facts: DataFrame) -> DataFrame:
    """The tag that all values fit, and what they are cast to."""
    def all_fit(bit: int) -> Column:
        return F.col("fits").bitwiseAND(bit) != 0

    tag = (
        F.when(F.col("fits").isNull(), "string")
        .when(all_fit(_FITS_INTEGER), "integer")
        .when(all_fit(_FITS_NUMBER), "number")
        .when(all_fit(_FITS_BOOLEAN), "boolean")
        .otherwise("string")
    )
    cast_to = (
        F.when(F.col("type") == "number", "double")
        .when(F.col("type") != "integer", F.col("type"))
        .when(all_fit(_FITS_LONG), "bigint")
        .when(F.col("digits") <= 38, "decimal(38,0)")
        .otherwise("string")
    )
    return facts.withColumn("type", tag).withColumn("cast_to", cast_to)


def infer_tags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: ``column, position, type, cast_to``.

    Text columns get the tightest of integer, number, boolean and string that every non-empty
    value fits; other columns keep the tag of their type. One scan, one row shuffled per task.
    """
    names = columns or df.columns
    known = {f.name: f.dataType for f in df.schema}
    text = [n for n in names if isinstance(known[n], T.StringType)]
    fixed = [n for n in names if n not in text]
    rows = []
    if text:
        rows.append(_typed(column_facts(df, text)).select("column", "type", "cast_to"))
    if fixed:
        spark = df.sparkSession
        rows.append(
            spark.createDataFrame(
                [(n, tag_of(known[n]), known[n].simpleString()) for n in fixed],
                "column string, type string, cast_to string",
            )
        )
    out = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("column"))
    return out.select("column", position.alias("position"), "type", "cast_to")


def apply_inferred(df: DataFrame) -> DataFrame:
    """Cast text columns to their inferred types and turn empty text into null.

    Runs the inference job first; one row per column reaches the driver.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    return apply_types(df, {r["column"]: r["cast_to"] for r in infer_tags(df, text).collect()})


def apply_types(df: DataFrame, target: dict[str, str]) -> DataFrame:
    """Cast the named text columns; empty text, and text that is no such value, is null."""

    def typed(name: str) -> Column:
        if name not in target:
            return F.col(f"`{name}`")
        filled = F.when(F.col(f"`{name}`") != "", F.col(f"`{name}`"))
        if target[name] == "string":
            return filled.alias(name)
        return filled.try_cast(target[name]).alias(name)

    return df.select(*[typed(n) for n in df.columns])
