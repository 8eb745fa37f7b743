"""Column, row and regex filters compiled to Spark columns."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tabsift.errors import UNKNOWN_FILTER, TabsiftError, invalid
from tabsift.operators import expression

# The row operators and the regex flags.
ROW_OPS = (
    "eq", "ne", "gt", "gte", "lt", "lte", "contains", "starts_with", "ends_with",
    "regex", "in", "not_in", "is_null", "is_not_null",
)
TEXT_OPS = ("contains", "starts_with", "ends_with", "regex")
LIST_OPS = ("in", "not_in")
NULL_OPS = ("is_null", "is_not_null")
REGEX_FLAGS = ("i", "m", "s")


# ---- columns -------------------------------------------------------------------------------

def _kept(spec: dict) -> list[str]:
    for key in ("keep", "include", "columns"):
        if spec.get(key):
            return list(spec[key])
    return []


def _column_problems(df: DataFrame, spec: dict) -> list[str]:
    problems = []
    for key in ("keep", "include", "columns", "exclude"):
        if spec.get(key) is not None and not isinstance(spec[key], (list, tuple)):
            problems.append(f"give {key} as a list of names")
    if not problems and not _kept(spec) and not spec.get("exclude"):
        problems.append("name the columns to keep or to exclude")
    return problems


def keep_columns(df: DataFrame, spec: dict) -> DataFrame:
    """Listed columns in listed order, minus the excluded; unknown names are skipped."""
    wanted = _kept(spec) or df.columns
    dropped = set(spec.get("exclude") or ())
    chosen = dict.fromkeys(n for n in wanted if n in df.columns and n not in dropped)
    return df.select(*[F.col(f"`{n}`") for n in chosen])


# ---- rows ----------------------------------------------------------------------------------

def as_text(column: Column, dtype: T.DataType) -> Column:
    """A value as text; booleans read ``True`` / ``False``."""
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")


def _literal_problem(value, dtype: T.DataType) -> str | None:
    if value is None:
        return None
    try:
        if isinstance(dtype, (T.IntegralType, T.FractionalType)):
            if isinstance(value, bool):
                raise ValueError
            float(value)
        elif isinstance(dtype, T.BooleanType):
            if str(value).strip().lower() not in ("true", "false", "0", "1", "yes", "no"):
                raise ValueError
        elif isinstance(dtype, T.DateType):
            dt.datetime.fromisoformat(str(value))
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            dt.datetime.fromisoformat(str(value))
    except (TypeError, ValueError):
        return f"{value!r} is not a {dtype.simpleString()}"
    return None


def _literal(value, dtype: T.DataType) -> Column:
    """The literal in the column's type, so the comparison reaches the scan without a cast."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.IntegralType):
        number = Decimal(str(value))
        if number != number.to_integral_value():
            return F.lit(float(value))
        fits = -(2 ** 63) <= number < 2 ** 63
        return F.lit(int(number)) if fits else F.lit(float(value))
    return F.lit(str(value)).cast(dtype)


def row_predicate(df: DataFrame, col: str, op: str, value=None) -> Column:
    """One of the fourteen row operators as a column that is never null under ``filter``."""
    dtype = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op in TEXT_OPS:
        text, wanted = as_text(c, dtype), str(value)
        if op == "regex":
            return text.rlike(pattern_of(wanted))
        match = {
            "contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith,
        }
        return match[op](wanted)
    if op in LIST_OPS:
        listed = [_literal(v, dtype) for v in value if v is not None]
        has_null = any(v is None for v in value)
        member = c.isin(*listed) if listed else F.lit(False)
        if op == "in":
            return member | c.isNull() if has_null else member
        return ~member & c.isNotNull() if has_null else ~member | c.isNull()
    lit = _literal(value, dtype)
    if op == "eq":
        return c.eqNullSafe(lit)
    if op == "ne":
        return ~c.eqNullSafe(lit)
    return {"gt": c > lit, "gte": c >= lit, "lt": c < lit, "lte": c <= lit}[op]


def _row_problems(df: DataFrame, spec: dict) -> list[str]:
    p = spec.get("predicate")
    if not isinstance(p, dict) or "col" not in p or "op" not in p:
        return ["a row filter takes a predicate with a column (col) and an operator (op)"]
    problems = []
    if p["op"] not in ROW_OPS:
        problems.append(f"{p['op']!r} is no row operator")
    if p["col"] not in df.columns:
        problems.append(f"the table has no column {p['col']!r}")
    if p["op"] in LIST_OPS and not isinstance(p.get("value"), (list, tuple)):
        problems.append(f"{p['op']} compares with a list of values")
    if problems or p["op"] in NULL_OPS:
        return problems
    if p["op"] == "regex":
        return _pattern_problems(df, str(p.get("value")))
    if p["op"] in TEXT_OPS:
        return []
    dtype = df.schema[p["col"]].dataType
    values = p["value"] if p["op"] in LIST_OPS else [p.get("value")]
    return [m for m in (_literal_problem(v, dtype) for v in values) if m]


def keep_rows(df: DataFrame, spec: dict) -> DataFrame:
    p = spec["predicate"]
    return df.filter(row_predicate(df, p["col"], p["op"], p.get("value")))


# ---- regex over every text column ------------------------------------------------------------

def pattern_of(pattern: str, flags: str = "") -> str:
    """A pattern in Spark's regex dialect.

    Named groups are respelled, and character classes and case folding cover all of Unicode.
    """
    numbers: dict[str, int] = {}

    def name(m: re.Match) -> str:
        # Java's names are letters and digits; numbering keeps distinct names distinct.
        return f"g{numbers.setdefault(m.group(1), len(numbers))}"

    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{name(m)}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{name(m)}>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    if "i" in flags or re.search(r"\\[wWdDsSbB]|\(\?[a-zA-Z]*i", out):
        flags += "U"
    return f"(?{flags}){out}" if flags else out


def _pattern_problems(df: DataFrame, pattern: str) -> list[str]:
    """Compile the pattern with the engine that will run it."""
    jvm = df.sparkSession._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern_of(pattern))
    except Exception as e:
        reason = str(getattr(e, "java_exception", e)).splitlines()[0]
        return [f"the pattern does not compile: {reason}"]
    return []


def _regex_problems(df: DataFrame, spec: dict) -> list[str]:
    problems = [f"{f!r} is no regex flag" for f in spec.get("flags") or () if f not in REGEX_FLAGS]
    if not isinstance(spec.get("pattern"), str):
        return problems + ["give the pattern as text"]
    return problems + _pattern_problems(df, spec["pattern"])


def keep_matching(df: DataFrame, spec: dict) -> DataFrame:
    """Rows where any text column matches the pattern."""
    flags = "".join(dict.fromkeys(spec.get("flags") or ()))
    pattern = pattern_of(spec["pattern"], flags)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.filter(F.lit(False))
    hits = [F.coalesce(F.col(f"`{n}`").rlike(pattern), F.lit(False)) for n in texts]
    return df.filter(reduce(or_, hits))


# ---- expression --------------------------------------------------------------------------------

def _expression_text(spec: dict) -> str | None:
    return spec.get("expr") or spec.get("expression")


def _expression_problems(df: DataFrame, spec: dict) -> list[str]:
    text = _expression_text(spec)
    if not isinstance(text, str) or not text.strip():
        return ["give the condition as text in expr"]
    try:
        expression.condition(df, text, sql_nulls=bool(spec.get("sql_nulls")))
    except AnalysisException as e:
        return [expression.explain_failure(e)]
    return []


def keep_where(df: DataFrame, spec: dict) -> DataFrame:
    text = _expression_text(spec)
    return df.filter(expression.condition(df, text, sql_nulls=bool(spec.get("sql_nulls"))))


# ---- dispatch --------------------------------------------------------------------------------

FILTERS = {
    "column": (keep_columns, _column_problems),
    "row": (keep_rows, _row_problems),
    "expression": (keep_where, _expression_problems),
    "regex": (keep_matching, _regex_problems),
}


def _lookup(spec: dict):
    kind = spec.get("kind")
    if kind not in FILTERS:
        raise TabsiftError(UNKNOWN_FILTER, f"rows cannot be filtered by {kind!r}")
    return FILTERS[kind]


def validate_filter(df: DataFrame, spec: dict) -> list[str]:
    return _lookup(spec)[1](df, spec)


def apply_filter(df: DataFrame, spec: dict) -> DataFrame:
    """Validate the spec against the schema, then add the filter to the plan."""
    run, check = _lookup(spec)
    problems = check(df, spec)
    if problems:
        raise invalid(problems)
    return run(df, spec)


def explain_filter(spec: dict) -> str:
    """One line saying what a filter keeps."""
    kind = spec.get("kind")
    if kind == "column":
        shown = ", ".join(_kept(spec)) or "every column"
        left_out = ", ".join(spec.get("exclude") or ())
        return f"shows {shown}" + (f" but not {left_out}" if left_out else "")
    if kind == "row":
        p = spec["predicate"]
        operand = "" if p["op"] in NULL_OPS else f" {p.get('value')!r}"
        return f"rows whose {p['col']} passes {p['op']}{operand}"
    if kind == "expression":
        return f"rows for which {_expression_text(spec)} holds"
    if kind == "regex":
        flags = "".join(spec.get("flags") or ())
        return f"rows with a text that matches /{spec['pattern']}/{flags}"
    raise TabsiftError(UNKNOWN_FILTER, f"rows cannot be filtered by {kind!r}")


def preview(df: DataFrame, spec: dict | None = None, sample_size: int = 20) -> DataFrame:
    """First rows after the filter; at least one row if there is any."""
    kept = apply_filter(df, spec) if spec else df
    return kept.limit(max(1, sample_size))
