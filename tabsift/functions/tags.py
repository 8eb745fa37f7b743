"""Scalar type tags and their Spark types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tag vocabulary.
TAGS = ("string", "number", "integer", "boolean", "datetime", "null")
NUMERIC_TAGS = ("integer", "number")

_SPARK_TYPE = {
    "string": T.StringType(),
    "number": T.DoubleType(),
    "integer": T.LongType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampType(),
    "null": T.NullType(),
}


def tag_of(dtype: T.DataType) -> str:
    """Tag of a Spark type; nested, variant and binary values carry the string tag."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "integer" if dtype.scale == 0 else "number"
    if isinstance(dtype, T.FractionalType):
        return "number"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.NullType):
        return "null"
    return "string"


def spark_type(tag: str) -> T.DataType:
    return _SPARK_TYPE[tag]


def schema_listing(df: DataFrame) -> list[dict]:
    """The published schema: one ``{name, type, nullable}`` per column."""
    return [
        {"name": f.name, "type": tag_of(f.dataType), "nullable": f.nullable} for f in df.schema
    ]


def tags_by_name(df: DataFrame) -> dict[str, str]:
    return {f.name: tag_of(f.dataType) for f in df.schema}


def variant_tag(value: Column) -> Column:
    """Tag of one VARIANT value; objects and arrays, the inner tree nodes, are ``null``."""
    kind = F.schema_of_variant(value)
    # Whole numbers of up to 18 digits are BIGINT, so a short decimal without fraction was 5.0.
    long_integer = kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return (
        F.when(value.isNull() | kind.isin("VOID"), "null")
        .when(kind.isin("BIGINT") | long_integer, "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind.isin("BOOLEAN"), "boolean")
        .when(kind.isin("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), "datetime")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), "null")
        .otherwise("string")
    )
