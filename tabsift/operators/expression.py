"""Expression filter: Spark SQL text with two-valued logic, plus user functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_signatures: dict[str, str] = {}

# One item of an expression's text: what must stay as written, an operator, a name or a sign.
_ITEM = re.compile(
    r"""\s+|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`"""
    r"""|\d+\.?\d*(?:[eE][+-]?\d+)?\w*|\.\d+|[^\W\d]\w*"""
    r"""|<=>|<=|>=|->|=>|!=|<>|==|\*\*|//|\|\||::|.""",
    re.DOTALL,
)
_EQUAL = {"=": "<=>", "==": "<=>", "!=": "IS DISTINCT FROM", "<>": "IS DISTINCT FROM"}
# What ends the operand of NOT, and what a name before a bracket is when it calls nothing.
_ENDS_NOT = {"AND", "OR", "THEN", "WHEN", "ELSE", "END", "AS"}
_WORDS = _ENDS_NOT | {
    "NOT", "IN", "LIKE", "ILIKE", "RLIKE", "REGEXP", "BETWEEN", "IS", "CASE", "DISTINCT", "FROM", "ESCAPE",
}
_PRODUCT = {"*", "/", "%", "//", "DIV"}


def two_valued(text: str) -> str:
    """The same condition under two-valued logic, where a null never makes a row undecided.

    ``=`` and ``!=`` treat null as an ordinary value, and what stands after a NOT counts as not met
    where it is null, whatever it is: a column, a comparison, LIKE, IN or BETWEEN. ``**`` and ``//``
    read as power and floor division; brackets, calls and texts are left as they are.
    """
    items = [t for t in _ITEM.findall(text) if not t.isspace()]
    nested, rest = _nested(items, 0)
    return " ".join([_written(nested), *items[rest:]])


def _nested(items: list[str], at: int) -> tuple[list, int]:
    """Items up to the bracket that closes this level; inner brackets are lists of their own."""
    out: list = []
    while at < len(items) and items[at] not in (")", "]"):
        if items[at] in ("(", "["):
            inner, end = _nested(items, at + 1)
            if end >= len(items):  # an unclosed bracket is for Spark to report
                return out + items[at:], end
            out.append([items[at], inner, items[end]])
            at = end + 1
        else:
            out.append(items[at])
            at += 1
    return out, at


def _word(item) -> str:
    return item.upper() if isinstance(item, str) else ""


def _written(level: list) -> str:
    parts: list[list] = [[]]
    for item in level:
        if item == ",":
            parts.append([])
        else:
            parts[-1].append(item)
    return ", ".join(_negated(_arithmetic([_plain(i) for i in p])) for p in parts)


def _plain(item):
    if isinstance(item, list):
        return _Group(item[0] + _written(item[1]) + item[2])
    if item.upper() == "NONE":
        return "NULL"
    return _EQUAL.get(item, item)


class _Group(str):
    """A bracket with all that is in it."""


def _negated(items: list[str]) -> str:
    """Each prefix NOT asks whether its operand is anything but true; the operand ends where a
    logical operator of the same level does, but for the AND of a BETWEEN."""
    out: list[str] = []
    for i, item in enumerate(items):
        before = _word(items[i - 1]) if i else ""
        prefix = _word(item) in ("NOT", "!") and (
            not before or before in _ENDS_NOT | {"NOT", "!", "<=>", "CASE", "->"})
        if not prefix:
            out.append(item)
            continue
        end, between = i + 1, 0
        while end < len(items):
            word = _word(items[end])
            if word == "AND" and between:
                between -= 1
            elif word in _ENDS_NOT:
                break
            between += word == "BETWEEN"
            end += 1
        operand = _negated(items[i + 1:end])
        return " ".join([*out, f"TRUE IS DISTINCT FROM ({operand})", _negated(items[end:])]).strip()
    return " ".join(out)


def _arithmetic(items: list[str]) -> list[str]:
    """``a ** b`` as power and ``a // b`` as floor division."""
    items = _called(items)
    while "**" in items:
        at = len(items) - 1 - items[::-1].index("**")  # the last one binds first
        end = at + 2
        while end < len(items) and items[end - 1] in ("-", "+"):
            end += 1
        items[at - 1:end] = [f"power({items[at - 1] if at else ''}, {''.join(items[at + 1:end])})"]
    while "//" in items:
        at = items.index("//")
        start = at - 1
        while start >= 2 and _word(items[start - 1]) in _PRODUCT:
            start -= 2
        signed = start >= 1 and items[start - 1] in ("-", "+")
        if signed and (start == 1 or not re.fullmatch(r"[\w.)\]'\"`]+", items[start - 2][-1])
                       or _word(items[start - 2]) in _WORDS):
            start -= 1
        end = at + 2
        while end < len(items) and items[end - 1] in ("-", "+"):
            end += 1
        left, right = " ".join(items[max(start, 0):at]), "".join(items[at + 1:end])
        items[max(start, 0):end] = [f"floor(({left}) / ({right}))"]
    return items


def _called(items: list[str]) -> list[str]:
    """Names joined with the brackets they call, and with the fields behind a dot."""
    out: list[str] = []
    for item in items:
        joins = out and (
            (isinstance(item, _Group) and re.fullmatch(r"[\w.`\])]+|.*[)\]]", out[-1], re.DOTALL)
             and out[-1].upper() not in _WORDS and not out[-1].isdigit())
            or item == "." or out[-1].endswith("."))
        if joins:
            out[-1] = out[-1] + item
        else:
            out.append(str(item) if not isinstance(item, _Group) else item)
    return out


def condition(df: DataFrame, text: str, sql_nulls: bool = False) -> Column:
    """Boolean column for ``df.filter``; a value that is not boolean counts by truthiness."""
    column = F.expr(text if sql_nulls else two_valued(text))
    dtype = df.select(column.alias("c")).schema[0].dataType
    if isinstance(dtype, T.BooleanType):
        return column
    if isinstance(dtype, T.NumericType):
        return column != 0
    if isinstance(dtype, T.StringType):
        return column != ""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.size(column) > 0
    return column.isNotNull()


def explain_failure(error: AnalysisException) -> str:
    kind = error.getCondition() or ""
    names = error.getMessageParameters() or {}
    if kind.startswith("UNRESOLVED_COLUMN"):
        return f"unknown name: {names.get('objectName', '')}"
    if kind.startswith("UNRESOLVED_ROUTINE"):
        return f"unknown function: {names.get('routineName', '')}"
    if kind.startswith("PARSE_SYNTAX_ERROR"):
        return f"syntax error near {names.get('error', '')}"
    return str(error).splitlines()[0]


def register_function(spark: SparkSession, name: str, fn, returns="double", signature: str = ""):
    """Make ``fn`` callable in expressions.

    A pandas UDF runs on Arrow batches and is the form to prefer; a plain function is wrapped as
    an Arrow-optimised UDF of type ``returns``.
    """
    if hasattr(fn, "asNondeterministic"):
        registered = spark.udf.register(name, fn)
    else:
        registered = spark.udf.register(name, F.udf(fn, returns, useArrow=True))
    _signatures[name] = signature
    return registered


def registered_functions() -> dict[str, str]:
    return dict(_signatures)
