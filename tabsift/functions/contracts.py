"""Message contracts checked as column expressions, and typed message bodies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.functions.exprs import unread_reason, whole_json

# Formats of identifiers and times.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


@dataclass(frozen=True)
class Field:
    """What one key of a message must hold. ``low`` / ``high`` bound a number or a text length."""

    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    sql: str = "string"


def _id(required=True) -> Field:
    return Field("uuid", required)


def _text(required=False, low=None, high=None) -> Field:
    return Field("text", required, low, high)


def _time(required=True) -> Field:
    return Field("time", required, sql="timestamp")


_TRACE = _text(True, 1, 128)
_PRIORITY = Field("integer", False, 0, 10, sql="bigint")

# Keys, kinds, bounds and enumerations of the four message types.
CONTRACTS: dict[str, dict[str, Field]] = {
    "jobs": {
        "job_id": _id(),
        "user_id": _id(),
        "kind": Field("enum", True,
                      allowed=("batch-filter", "convert", "analyze", "ai-anomaly-full")),
        "params": Field("object", True, sql="variant"),
        "priority": Field("integer", True, 0, 10, sql="bigint"),
        "created_at": _time(),
        "trace_id": _TRACE,
    },
    "job-results": {
        "job_id": _id(),
        "status": Field("enum", True, allowed=("running", "completed", "failed", "cancelled")),
        "progress": Field("number", False, 0, 100, sql="double"),
        "result_ref": _text(),
        "error": Field("object", False, keys=("code", "message"), sql="variant"),
        "finished_at": _time(),
        "trace_id": _TRACE,
    },
    "audit-events": {
        "event_id": _id(),
        "user_id": _id(False),
        "action": _text(True, 1, 128),
        "target": _text(False, None, 256),
        "metadata": Field("object", sql="variant"),
        "occurred_at": _time(),
        "trace_id": _TRACE,
    },
    "format-requests": {
        "request_id": _id(),
        "user_id": _id(),
        "sample_ref": _text(True),
        "user_label": _text(False, None, 256),
        "status": Field("enum", False,
                        allowed=("open", "triaged", "in-progress", "shipped", "rejected")),
        "priority": _PRIORITY,
        "github_issue": Field("integer", sql="bigint"),
        "action": Field("enum", False, allowed=("created", "updated")),
        "created_at": _time(False),
        "trace_id": _TRACE,
    },
}


def _at(key: str, dtype: str) -> Column:
    return F.try_variant_get("_tree", f"$.{key}", dtype)


def _staged(df: DataFrame, value: str, rules: dict[str, Field]) -> DataFrame:
    """Parse each message once and read each field once, as columns the checks refer to."""
    parsed = df.withColumn("_tree", whole_json(F.col(value)))
    reads = {
        # A message too large for a VARIANT may well be valid, so it gets an error of its own.
        "_large": F.coalesce(unread_reason(F.col(value), F.col("_tree")) == "too large", F.lit(False)),
        "_keys": F.map_keys(F.try_variant_get("_tree", "$", "map<string,variant>")),
    }
    for i, (key, rule) in enumerate(rules.items()):
        reads[f"_kind{i}"] = F.schema_of_variant(_at(key, "variant"))
        if rule.kind in ("integer", "number"):
            reads[f"_value{i}"] = _at(key, "double")
        elif rule.kind != "object":
            reads[f"_value{i}"] = _at(key, "string")
        for j, inner in enumerate(rule.keys):
            reads[f"_kind{i}_{j}"] = F.schema_of_variant(_at(f"{key}.{inner}", "variant"))
    return parsed.withColumns(reads)


def _field_ok(i: int, rule: Field) -> Column:
    """Whether a present value meets its rule."""
    kind, value = F.col(f"_kind{i}"), F.col(f"_value{i}")
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    if rule.kind == "object":
        ok = kind.startswith("OBJECT")
        for j in range(len(rule.keys)):
            ok = ok & (F.col(f"_kind{i}_{j}") == "STRING")
        return ok
    size = value
    if rule.kind == "integer":
        ok = whole
    elif rule.kind == "number":
        ok = whole | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    else:
        ok, size = kind == "STRING", F.length(value)
    if rule.kind == "uuid":
        return ok & value.rlike(UUID)
    if rule.kind == "time":
        return ok & value.rlike(DATE_TIME)
    if rule.kind == "enum":
        return ok & value.isin(*rule.allowed)
    if rule.low is not None:
        ok = ok & (size >= rule.low)
    if rule.high is not None:
        ok = ok & (size <= rule.high)
    return ok


def _errors(rules: dict[str, Field]) -> Column:
    keys, found = F.col("_keys"), []
    for i, (key, rule) in enumerate(rules.items()):
        present = F.array_contains(keys, key)
        if rule.required:
            found.append(F.when(~present, F.lit(f"missing {key}")))
        ok = F.coalesce(_field_ok(i, rule), F.lit(False))
        found.append(F.when(present & ~ok, F.lit(f"invalid {key}")))
    extra = F.transform(
        F.array_except(keys, F.array(*[F.lit(k) for k in rules])),
        lambda k: F.concat(F.lit("unexpected "), k),
    )
    problems = F.concat(F.array_compact(F.array(*found)), F.array_sort(extra))
    return F.when(F.col("_large"), F.array(F.lit("too large to check"))).when(
        keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(problems)


def _typed(rules: dict[str, Field]) -> Column:
    return F.struct(*[_at(k, r.sql).alias(k) for k, r in rules.items()])


def _kept(df: DataFrame, columns: list[str], *made: str) -> DataFrame:
    """``columns`` and what was ``made`` of a message. A filter on that would be pushed below the parse and
    repeat it for every check; below the unfolding of one row it is not."""
    return df.select(*columns, F.inline(F.array(F.struct(*made))))


def check_messages(df: DataFrame, value: str, contract: str) -> DataFrame:
    """Adds ``errors``, what is wrong with each JSON message; empty for a valid one.

    Works on batches and streams alike.
    """
    rules = CONTRACTS[contract]
    checked = _staged(df, value, rules).select(*df.columns, _errors(rules).alias("errors"))
    return _kept(checked, df.columns, "errors")


def split_messages(df: DataFrame, value: str, contract: str) -> DataFrame:
    """Adds ``errors`` and the typed ``message``, a struct that is null for an invalid one."""
    rules = CONTRACTS[contract]
    checked = _staged(df, value, rules).select(*df.columns, "_tree", _errors(rules).alias("errors"))
    split = checked.select(
        *df.columns, "errors", F.when(F.size("errors") == 0, _typed(rules)).alias("message"))
    return _kept(split, df.columns, "errors", "message")


def valid_messages(df: DataFrame, value: str, contract: str) -> DataFrame:
    """Valid messages only, with their typed fields beside the other columns."""
    others = [c for c in df.columns if c != value]
    return split_messages(df, value, contract).select(
        *others, F.inline(F.array_compact(F.array("message")))
    )


def dead_letters(df: DataFrame, value: str, contract: str) -> DataFrame:
    """Invalid messages with their ``errors``."""
    checked = check_messages(df, value, contract)
    bad = F.when(F.size("errors") > 0, F.array(F.struct("errors")))
    return checked.select(*df.columns, F.inline(bad))
