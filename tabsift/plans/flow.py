"""Whole runs: read, filter, then preview, analyse or convert, and saved chains of such steps."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.errors import (
    NOT_TABULAR, UNKNOWN_ANALYSIS, UNKNOWN_FILTER, UNKNOWN_FORMAT, UNKNOWN_JOB_KIND,
    UNKNOWN_OUTPUT_FORMAT, TabsiftError, invalid,
)
from tabsift.operators.charts import chart_series, chart_suggestions, recommend_chart
from tabsift.operators.filters import FILTERS, apply_filter, preview
from tabsift.operators.grouping import group_by, group_by_problems
from tabsift.operators.paths import path_profile
from tabsift.operators.profile import table_profile
from tabsift.operators.quality import quality_report
from tabsift.operators.ranking import latest
from tabsift.operators.summary import summary
from tabsift.sources.readers import READERS, is_tree, read_any
from tabsift.sources.writers import WRITERS, write_any
from tabsift.usage.jobs import RESULT_PREFIX


def _schema_infer(df: DataFrame, column: str | None = None, **options) -> DataFrame:
    """Paths of a JSON text or VARIANT column, of documents, or of whole rows."""
    if column is None and is_tree(df):
        column = df.columns[0]
    if column is None:
        whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        return path_profile(df.select(whole.alias("_t")), "_t", **options)
    if isinstance(df.schema[column].dataType, T.VariantType):
        df = df.select(F.to_json(column).alias(column))
    return path_profile(df, column, **options)


ANALYSES: dict[str, Callable[..., DataFrame]] = {
    "group_by": group_by,
    "summary_stats": summary,
    "schema_infer": _schema_infer,
    "chart_suggest": chart_suggestions,
    "chart_series": chart_series,
    "chart_recommend": recommend_chart,
    "profile": table_profile,
    "quality": quality_report,
}

_disabled: set[str] = set()


def disable(*ids: str) -> None:
    """Switch off formats, filters or analyses by ``format-csv``, ``filter-row``,
    ``analysis-group_by`` and the like."""
    _disabled.update(ids)


def enable(*ids: str) -> None:
    _disabled.difference_update(ids)


def _require(kind: str, name: str, known: dict, code: str) -> None:
    if name not in known or f"{kind}-{name}" in _disabled:
        raise TabsiftError(code, f"no {kind} named {name!r}")


def validate_analysis(df: DataFrame, kind: str, options: dict) -> list[str]:
    _require("analysis", kind, ANALYSES, UNKNOWN_ANALYSIS)
    if kind == "group_by":
        return group_by_problems(df, list(options.get("by") or []), dict(options.get("agg") or {}))
    return []


def filtered(df: DataFrame, spec: dict | None) -> DataFrame:
    if not spec:
        return df
    _require("filter", spec.get("kind"), FILTERS, UNKNOWN_FILTER)
    return apply_filter(df, spec)


def analyze(
    df: DataFrame, kind: str, options: dict | None = None, spec: dict | None = None
) -> DataFrame:
    """An analysis over the rows a filter keeps."""
    options = options or {}
    rows = filtered(df, spec)
    problems = validate_analysis(rows, kind, options)
    if problems:
        raise invalid(problems)
    return ANALYSES[kind](rows, **options)


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    if fmt is not None:
        _require("format", fmt, READERS, UNKNOWN_FORMAT)
    return read_any(spark, path, fmt, **options)


def tabular(df: DataFrame) -> DataFrame:
    """Refuse documents where rows are needed."""
    if is_tree(df):
        raise TabsiftError(NOT_TABULAR, "flatten the documents to columns first")
    return df


def preview_path(
    spark: SparkSession, path: str, spec: dict | None = None, sample_size: int = 20,
    fmt: str | None = None, **options,
) -> DataFrame:
    return preview(filtered(tabular(load(spark, path, fmt, **options)), spec), None, sample_size)


def analyze_path(
    spark: SparkSession, path: str, kind: str, analysis_options: dict | None = None,
    spec: dict | None = None, fmt: str | None = None, **options,
) -> DataFrame:
    data = load(spark, path, fmt, **options)
    if is_tree(data) and kind == "schema_infer":
        return analyze(data, kind, analysis_options)
    return analyze(tabular(data), kind, analysis_options, spec)


def convert(
    spark: SparkSession, source: str, target: str, to: str, spec: dict | None = None,
    fmt: str | None = None, mode: str = "error", **options,
) -> str:
    """Read, filter and write in another format; any filter and any writable format.

    Documents are written as they are: filters are for rows.
    """
    _require("format", to, WRITERS, UNKNOWN_OUTPUT_FORMAT)
    data = load(spark, source, fmt, **options)
    write_any(data if is_tree(data) else filtered(data, spec), target, to, mode=mode)
    return target


# ---- chains ------------------------------------------------------------------------------------

def _filter_spec(step: dict) -> dict:
    """The filter of a step: ``mode`` names the kind, a text predicate is an expression."""
    spec = {k: v for k, v in step.items() if k not in ("kind", "mode")}
    spec["kind"] = step.get("mode") or step.get("filter_kind") or "expression"
    if isinstance(spec.get("predicate"), str):
        return {"kind": "expression", "expr": spec["predicate"]}
    return spec


def run_operations(df: DataFrame, operations: list[dict], target: str | None = None) -> DataFrame:
    """Apply a list of steps as one plan; a ``convert`` step writes to ``target``.

    Steps are ``{kind: filter, mode, ...}``, ``{kind: analyze, analysis, options}`` and
    ``{kind: convert, to}``.
    """
    for step in operations:
        kind = step.get("kind")
        if kind == "filter":
            df = filtered(df, _filter_spec(step))
        elif kind == "analyze":
            df = analyze(df, step["analysis"], step.get("options"))
        elif kind == "convert":
            _require("format", step["to"], WRITERS, UNKNOWN_OUTPUT_FORMAT)
            if target is not None:
                write_any(df, target, step["to"])
        else:
            raise invalid([f"unknown step: {kind!r}"])
    return df


def run_job(spark: SparkSession, job: dict, base: str) -> str:
    """Run a submitted job and return where its result lies.

    ``params`` hold ``input.ref`` (and ``input.format``), ``operations`` and, for an analysis,
    ``analysis`` with ``options``.
    """
    kind, params = job["kind"], job["params"]
    if kind not in RESULT_PREFIX:
        raise TabsiftError(UNKNOWN_JOB_KIND, f"unknown job kind: {kind}")
    source = params["input"]
    data = load(spark, source["ref"], source.get("format") or source.get("detected_format"))
    operations = list(params.get("operations") or [])
    if kind == "analyze":
        operations.append({
            "kind": "analyze", "analysis": params["analysis"], "options": params.get("options"),
        })
    elif kind == "ai-anomaly-full":
        operations.append({"kind": "analyze", "analysis": "quality", "options": {}})
    path = f"{base.rstrip('/')}/results/{job['user_id']}/{RESULT_PREFIX[kind]}/{job['job_id']}"
    if not any(step.get("kind") == "convert" for step in operations):
        operations.append({"kind": "convert", "to": "json"})
    run_operations(data, operations, path)
    return path


# ---- recipes -------------------------------------------------------------------------------------

def current_recipes(recipes: DataFrame) -> DataFrame:
    """The latest save per user and name, newest first."""
    fields = [c for c in recipes.columns if c not in ("user_id", "name")]
    return latest(
        recipes, ["user_id", "name"], [F.col("updated_at"), F.col("id")], fields
    ).orderBy(F.col("updated_at").desc(), "user_id", "name")


def replay(df: DataFrame, recipe: str | dict, target: str | None = None) -> DataFrame:
    """Run a saved recipe on a table."""
    body = json.loads(recipe) if isinstance(recipe, str) else recipe
    return run_operations(df, body["operations"], target)
