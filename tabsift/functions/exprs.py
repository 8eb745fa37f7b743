"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def whole_json(text: Column) -> Column:
    """The parsed text if it is one JSON value and nothing else, else null."""
    items = json_items(text)
    return F.when(F.size(items) == 1, items[0])


def json_items(text: Column) -> Column:
    """The JSON values in a text, between commas; null if there is anything else in it."""
    # The parser stops after the first value; inside an array anything that follows is an error.
    return F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]"))), "$", "array<variant>"
    )


# A text beyond this many bytes may not fit a VARIANT.
VARIANT_BYTES = 16 << 20


def whole_json_or_fail(text: Column) -> Column:
    """``whole_json`` that fails, instead of giving null, where a text may be too large to tell."""
    message = F.concat(
        F.lit("a text of "), F.octet_length(text).cast("string"),
        F.lit(" bytes is no JSON or more than a VARIANT holds"))
    return F.when(F.octet_length(text) <= VARIANT_BYTES, whole_json(text)).when(
        F.octet_length(text) > VARIANT_BYTES,
        F.coalesce(whole_json(text), F.raise_error(message).cast("variant")))


def unread_reason(text: Column, tree: Column) -> Column:
    """Why a text has no tree: ``empty``, ``too large`` or ``malformed``; null where it has one."""
    return (
        F.when(tree.isNotNull(), F.lit(None).cast("string"))
        .when(~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"\S")), "empty")
        .when(F.octet_length(text) > VARIANT_BYTES, "too large").otherwise("malformed")
    )
