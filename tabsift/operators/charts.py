"""Chart suggestions from a schema, the data behind them, and one recommended chart."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.functions.tags import NUMERIC_TAGS, tags_by_name
from tabsift.operators.summary import cardinality

# Scores, marks and axis types of the pair rules; kinds of a recommended chart.
LINE_SCORE, BAR_SCORE, POINT_SCORE = 0.95, 0.85, 0.7
VEGA_LITE = "https://vega.github.io/schema/vega-lite/v5.json"
CHART_KINDS = ("line", "bar", "pie", "histogram", "scatter", "heatmap")

_ROLE = {
    "datetime": "temporal", "integer": "numeric", "number": "numeric",
    "string": "categorical", "boolean": "categorical",
}
_PAIR_RULES = {
    ("temporal", "numeric"): ("line", LINE_SCORE, "temporal"),
    ("categorical", "numeric"): ("bar", BAR_SCORE, "nominal"),
    ("numeric", "numeric"): ("point", POINT_SCORE, "quantitative"),
}
_SUGGESTIONS = (
    "rank int, mark string, score double, x string, y string, rationale string, spec string"
)


def chart_pairs(df: DataFrame) -> list[dict]:
    """Every column pair that makes a chart, best score first, schema order within a score."""
    tags = tags_by_name(df)
    found = []
    for a, b in combinations(df.columns, 2):
        for x, y in ((a, b), (b, a)):
            rule = _PAIR_RULES.get((_ROLE.get(tags[x]), _ROLE.get(tags[y])))
            if rule:
                mark, score, axis = rule
                found.append({"mark": mark, "score": score, "x": x, "y": y, "x_type": axis})
                break
    found.sort(key=lambda c: -c["score"])
    return [{"rank": i + 1, **c} for i, c in enumerate(found)]


def chart_suggestions(df: DataFrame) -> DataFrame:
    """``rank, mark, score, x, y, rationale, spec``; read from the schema, no data touched."""
    rows = []
    for c in chart_pairs(df):
        spec = {
            "$schema": VEGA_LITE,
            "mark": c["mark"],
            "encoding": {
                "x": {"field": c["x"], "type": c["x_type"]},
                "y": {"field": c["y"], "type": "quantitative"},
            },
        }
        why = f"{c['x_type']} x against quantitative y"
        rows.append((c["rank"], c["mark"], c["score"], c["x"], c["y"], why, json.dumps(spec)))
    return df.sparkSession.createDataFrame(rows, _SUGGESTIONS)


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of an equal-width bin; the top edge belongs to the last one."""
    width = (high - low) / F.lit(bins)
    at = F.when(width > 0, F.floor((value - low) / width)).otherwise(F.lit(0))
    return F.least(at, F.lit(bins - 1)).cast("int")


def chart_series(
    df: DataFrame, charts: list[dict] | None = None, time_unit: str = "month", bins: int = 20
) -> DataFrame:
    """The points of each chart: ``rank, mark, score, x, y, x_value, y_bin, y_value, n``.

    A line averages y per time unit, a bar per category. A point chart counts rows per cell of a
    ``bins`` by ``bins`` grid, so every row is in it and its size stays fixed. All charts come from
    one scan and one shuffle, combined per task first.
    """
    charts = chart_pairs(df) if charts is None else charts
    if not charts:
        return df.sparkSession.createDataFrame(
            [], "rank int, mark string, score double, x string, y string, x_value string, "
                "y_bin int, y_value double, n bigint",
        )
    scatter = sorted({c[k] for c in charts if c["mark"] == "point" for k in ("x", "y")})
    edges = None
    if scatter:
        row = df.agg(*[
            F.struct(
                F.min(F.col(f"`{n}`").cast("double")).alias("low"),
                F.max(F.col(f"`{n}`").cast("double")).alias("high"),
            ).alias(f"e{i}") for i, n in enumerate(scatter)
        ])
        edges = row.select(F.struct(*[f"e{i}" for i in range(len(scatter))]).alias("e")).scalar()

    def number(name: str) -> Column:
        return F.col(f"`{name}`").cast("double")

    def binned(name: str) -> Column:
        e = edges[f"e{scatter.index(name)}"]
        return _bin(number(name), e["low"], e["high"], bins)

    entries = []
    for c in charts:
        x = F.col(f"`{c['x']}`")
        if c["mark"] == "line":
            key = F.date_format(F.date_trunc(time_unit, x), "yyyy-MM-dd HH:mm:ss")
        elif c["mark"] == "bar":
            key = x.cast("string")
        else:
            key = binned(c["x"]).cast("string")
        y_bin = binned(c["y"]) if c["mark"] == "point" else F.lit(None).cast("int")
        entry = F.struct(
            F.lit(c["rank"]).alias("rank"), key.alias("x_value"), y_bin.alias("y_bin"),
            number(c["y"]).alias("value"),
        )
        entries.append(F.when(x.isNotNull() & F.col(f"`{c['y']}`").isNotNull(), entry))
    points = (
        df.select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("rank", "x_value", "y_bin")
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    )
    facts = F.element_at(
        F.array(*[
            F.struct(
                F.lit(c["mark"]).alias("mark"), F.lit(c["score"]).alias("score"),
                F.lit(c["x"]).alias("x"), F.lit(c["y"]).alias("y"),
            ) for c in charts
        ]),
        F.array_position(F.array(*[F.lit(c["rank"]) for c in charts]), F.col("rank")).cast("int"),
    )
    return points.withColumn("f", facts).select(
        "rank", "f.mark", "f.score", "f.x", "f.y", "x_value", "y_bin",
        F.when(F.col("f.mark") != "point", F.col("mean")).alias("y_value"), "n",
    )


FEW, SOME = 10, 50


def recommend_chart(df: DataFrame) -> DataFrame:
    """One chart picked from schema and distinct counts: ``kind, x, y, color, justification``.

    One row per column reaches the driver.
    """
    tags = tags_by_name(df)
    distinct = {r["column"]: r["distinct"] for r in cardinality(df).collect()}
    times = [n for n in df.columns if tags[n] == "datetime"]
    groups = sorted(
        (n for n in df.columns if _ROLE.get(tags[n]) == "categorical" and distinct[n] <= SOME),
        key=lambda n: distinct[n],
    )
    # A measured quantity before an id: fractions first, then the columns with most values.
    numbers = sorted(
        (n for n in df.columns if tags[n] in NUMERIC_TAGS),
        key=lambda n: (tags[n] != "number", -distinct[n]),
    )
    color = next((g for g in groups if 2 <= distinct[g] <= FEW), None)
    if times and numbers:
        pick = ("line", times[0], numbers[0], color, f"{numbers[0]} over {times[0]}")
    elif groups and numbers:
        second = next((g for g in groups[1:] if distinct[g] <= FEW), None)
        pick = ("bar", groups[0], numbers[0], second,
                f"{numbers[0]} compared across {distinct[groups[0]]} values of {groups[0]}")
    elif len(numbers) >= 2:
        pick = ("scatter", numbers[0], numbers[1], None,
                f"{numbers[1]} against {numbers[0]}")
    elif numbers:
        pick = ("histogram", numbers[0], None, None, f"distribution of {numbers[0]}")
    elif len(groups) >= 2:
        pick = ("heatmap", groups[0], groups[1], None,
                f"rows per pair of {groups[0]} and {groups[1]}")
    elif groups and distinct[groups[0]] <= FEW:
        pick = ("pie", groups[0], None, None, f"share of each value of {groups[0]}")
    else:
        first = df.columns[0] if df.columns else None
        pick = ("bar", first, None, None, f"rows per value of {first}")
    return df.sparkSession.createDataFrame(
        [pick], "kind string, x string, y string, color string, justification string"
    )
