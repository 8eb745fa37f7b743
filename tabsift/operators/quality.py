"""Data-quality findings computed over the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.functions.tags import NUMERIC_TAGS, tag_of
from tabsift.operators.infer import value_tag
from tabsift.operators.quantiles import SMALL_INPUT, exact_quantiles

# Finding kinds and severities.
FINDING_KINDS = (
    "outlier", "missing_values", "format_inconsistency", "possible_duplicate", "type_drift",
)
SEVERITIES = ("low", "medium", "high")

FENCE = 1.5
# Labels up to this length are counted as they are.
LONG_LABEL = 64
MINORITY = 0.1
_FINDING = ("kind", "column", "severity", "affected", "share", "description", "suggested_action")


def _by_share(share: Column, medium: float, high: float) -> Column:
    return F.when(share < medium, "low").when(share <= high, "medium").otherwise("high")


def _percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def _finding(df: DataFrame, kind: str, severity: Column, text: Column, action: str) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), F.col("column"), severity.alias("severity"),
        F.col("affected"), F.col("share"), text.alias("description"),
        F.lit(action).alias("suggested_action"),
    )


def _filled(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return F.nullif(c, F.lit("")) if isinstance(f.dataType, T.StringType) else c


def _text_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if isinstance(f.dataType, T.StringType)]


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "kind string, column string, severity string, affected bigint, share double, "
            "description string, suggested_action string",
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with null or empty values: under 10 % low, up to 30 % medium, above high."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(_filled(f)).alias(f"c{i}") for i, f in enumerate(df.schema)],
    )
    cells = F.array(*[
        F.struct(
            F.lit(f.name).alias("column"), (F.col("rows") - F.col(f"c{i}")).alias("affected"),
            F.try_divide(F.col("rows") - F.col(f"c{i}"), F.col("rows")).alias("share"),
        ) for i, f in enumerate(df.schema)
    ])
    found = row.select(F.inline(cells)).filter(F.col("affected") > 0)
    return _finding(
        found, "missing_values", _by_share(F.col("share"), 0.1, 0.3),
        F.concat(_percent(F.col("share")), F.lit(" of the values are missing")),
        "fill the gaps or drop the column",
    )


def outliers(df: DataFrame, small_input: int = SMALL_INPUT) -> DataFrame:
    """Numeric columns with values beyond 1.5 interquartile ranges from the quartiles.

    Severity follows the farthest value: more than 10 ranges beyond its fence is high, 3 medium.
    """
    names = [f.name for f in df.schema if tag_of(f.dataType) in NUMERIC_TAGS]
    if not names:
        return _none(df)
    values = {n: F.col(f"`{n}`").cast("double") for n in names}
    quartiles = exact_quantiles(df, [], values, [0.25, 0.75], small_input=small_input)

    def at(name: str, p: float) -> Column:
        here = (F.col("measure") == name) & (F.col("prob") == p)
        return F.max(F.when(here, F.col("value")))

    fences = quartiles.agg(*[
        F.struct(at(n, 0.25).alias("q1"), at(n, 0.75).alias("q3")).alias(f"f{i}")
        for i, n in enumerate(names)
    ])
    fence = fences.select(F.struct(*[f"f{i}" for i in range(len(names))]).alias("f")).scalar()
    cells, aggregates = [], []
    for i, n in enumerate(names):
        q1, q3 = fence[f"f{i}"]["q1"], fence[f"f{i}"]["q3"]
        low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
        v = values[n]
        reach = F.greatest(low - F.min(v), F.max(v) - high)
        aggregates += [
            F.count_if((v < low) | (v > high)).alias(f"out{i}"),
            F.count(v).alias(f"n{i}"),
            reach.alias(f"reach{i}"),
            F.max(q3 - q1).alias(f"iqr{i}"),
        ]
        cells.append(F.struct(
            F.lit(n).alias("column"), F.col(f"out{i}").alias("affected"),
            F.try_divide(F.col(f"out{i}"), F.col(f"n{i}")).alias("share"),
            F.when(F.col(f"iqr{i}") > 0, F.col(f"reach{i}") / F.col(f"iqr{i}"))
            .otherwise(F.lit(float("inf"))).alias("ranges"),
        ))
    found = df.agg(*aggregates).select(F.inline(F.array(*cells))).filter(F.col("affected") > 0)
    severity = (
        F.when(F.col("ranges") > 10, "high").when(F.col("ranges") > 3, "medium").otherwise("low")
    )
    return _finding(
        found, "outlier", severity,
        F.concat(F.col("affected").cast("string"),
                 F.lit(" values lie beyond 1.5 interquartile ranges")),
        "check the values or clip them",
    )


def shape_of(text: Column) -> Column:
    """Shape of a value: runs of digits read 9, of letters A, of blanks one blank."""
    shape = F.regexp_replace(text, r"\p{L}+", "A")
    shape = F.regexp_replace(shape, r"\p{Nd}+", "9")
    return F.regexp_replace(shape, r"\s+", " ")


def _minority(df: DataFrame, label) -> DataFrame:
    """``column, main, affected, share`` of text columns where few values leave the main label.

    Labels are counted per task before the shuffle, long ones under their digest; per column only
    the count of the commonest label and the total remain. A commonest label that was counted by
    digest, at most one per column, is looked up again.
    """
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), label(_filled(f)).alias("label"))
        for f in _text_fields(df)
    ])
    long = F.length("label") > LONG_LABEL
    labels = df.select(F.inline(cells)).filter(F.col("label").isNotNull())
    counts = (
        labels.withColumn("label", F.when(long, F.sha2("label", 256)).otherwise(F.col("label")))
        .groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.max_by("label", F.struct("n", "label"))
    found = (
        counts.groupBy("column")
        .agg(best.alias("key"), F.max("n").alias("main_n"), F.sum("n").alias("total"))
        .select(
            "column", "key", (F.col("total") - F.col("main_n")).alias("affected"),
            ((F.col("total") - F.col("main_n")) / F.col("total")).alias("share"),
        )
        .filter((F.col("affected") > 0) & (F.col("share") <= MINORITY))
    )
    wanted = found.select(F.col("column").alias("_column"), F.col("key").alias("_key"))
    whole = (
        labels.filter(long).withColumn("_digest", F.sha2("label", 256))
        .join(wanted, (F.col("column") == F.col("_column")) & (F.col("_digest") == F.col("_key")))
        .groupBy("_column", "_key").agg(F.first("label").alias("whole"))
    )
    return found.join(
        whole, (F.col("column") == F.col("_column")) & (F.col("key") == F.col("_key")), "left"
    ).select("column", F.coalesce("whole", "key").alias("main"), "affected", "share")


def format_inconsistency(df: DataFrame) -> DataFrame:
    """Text columns where at most 10 % of the values have another shape than the rest."""
    if not _text_fields(df):
        return _none(df)
    return _finding(
        _minority(df, shape_of), "format_inconsistency", _by_share(F.col("share"), 0.01, 0.05),
        F.concat(_percent(F.col("share")), F.lit(" of the values do not look like "),
                 F.col("main")),
        "bring the values to one format",
    )


def type_drift(df: DataFrame) -> DataFrame:
    """Text columns where at most 10 % of the values read as another type than the rest."""
    if not _text_fields(df):
        return _none(df)
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), value_tag(_filled(f)).alias("tag"))
        for f in _text_fields(df)
    ])
    tags = (
        df.select(F.inline(cells)).filter(F.col("tag").isNotNull())
        .groupBy("column", "tag").agg(F.count(F.lit(1)).alias("n"))
    )

    def of(tag: str) -> Column:
        return F.sum(F.when(F.col("tag") == tag, F.col("n")).otherwise(0))

    per_column = tags.groupBy("column").agg(
        F.max_by("tag", F.struct("n", "tag")).alias("main"), F.max("n").alias("main_n"),
        of("integer").alias("whole"), F.sum("n").alias("total"),
    )
    # A whole number is a number too.
    fits = F.col("main_n") + F.when(F.col("main") == "number", F.col("whole")).otherwise(0)
    found = per_column.select(
        "column", "main", (F.col("total") - fits).alias("affected"),
        ((F.col("total") - fits) / F.col("total")).alias("share"),
    ).filter((F.col("affected") > 0) & (F.col("share") <= MINORITY))
    return _finding(
        found, "type_drift", _by_share(F.col("share"), 0.01, 0.05),
        F.concat(_percent(F.col("share")), F.lit(" of the values are no "), F.col("main")),
        "correct the values or keep the column as text",
    )


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the listed values; wide rows are compared without shuffling them."""
    return F.sha2(F.to_json(
        F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}
    ), 256)


def possible_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows that repeat another row, over all or the given columns."""
    columns = subset or df.columns
    groups = df.select(row_digest(df, columns).alias("d")).groupBy("d").agg(
        F.count(F.lit(1)).alias("n")
    )
    found = groups.agg(
        F.lit(None).cast("string").alias("column") if subset is None
        else F.lit(", ".join(subset)).alias("column"),
        F.sum(F.col("n") - 1).alias("affected"),
        (F.sum(F.col("n") - 1) / F.sum("n")).alias("share"),
    ).filter(F.col("affected") > 0)
    return _finding(
        found, "possible_duplicate", _by_share(F.col("share"), 0.1, 0.3),
        F.concat(F.col("affected").cast("string"), F.lit(" rows repeat another row")),
        "remove the repeated rows",
    )


def quality_report(
    df: DataFrame, duplicate_keys: list[str] | None = None, limit: int | None = None,
    small_input: int = SMALL_INPUT,
) -> DataFrame:
    """All findings, worst first; ``limit`` cuts the report."""
    parts = [
        outliers(df, small_input), missing_values(df), format_inconsistency(df),
        possible_duplicates(df, duplicate_keys), type_drift(df),
    ]
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    found = (
        reduce(DataFrame.unionByName, parts)
        .select(*_FINDING)
        .orderBy(rank.desc(), F.col("kind"), F.col("column"))
    )
    return found if limit is None else found.limit(limit)
