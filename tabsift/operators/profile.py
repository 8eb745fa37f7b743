"""One-row description of a table: size, schema, sample and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.functions.tags import schema_listing
from tabsift.operators.summary import summary

# Sizes of the sample and of the observation list.
SAMPLE_ROWS = 50
MAX_OBSERVATIONS = 10


def observations(df: DataFrame, limit: int = MAX_OBSERVATIONS, **options) -> DataFrame:
    """``rank, column, observation``: what stands out, most telling first."""
    facts = summary(df, top_n=1, **options)
    rows = F.col("count") + F.col("nulls")
    head = F.col("top")[0]
    told = F.array_compact(F.array(
        F.when(F.col("nulls") > 0, F.struct(
            F.lit(1).alias("weight"),
            F.format_string("%s misses %.1f%% of its values", "column", F.col("nulls") / rows * 100)
            .alias("text"),
        )),
        F.when((F.col("distinct") == 1), F.struct(
            F.lit(2).alias("weight"),
            F.format_string("%s holds a single value", "column").alias("text"),
        )),
        F.when((F.col("distinct") == rows) & (rows > 1), F.struct(
            F.lit(3).alias("weight"),
            F.format_string("%s is different in every row", "column").alias("text"),
        )),
        F.when((F.col("distinct") > 1) & (F.size("top") > 0)
               & (head["count"] * 2 >= F.col("count")), F.struct(
            F.lit(4).alias("weight"),
            F.format_string("%s is %s in most rows", "column", head["value"]).alias("text"),
        )),
    ))
    # As many rows as columns and rules, so one small sort.
    listed = facts.select("column", "position", F.inline(told)).orderBy("weight", "position")
    return listed.limit(limit).select("column", "weight", "position", F.col("text").alias("observation"))


def table_profile(df: DataFrame, total_bytes: int | None = None, **options) -> DataFrame:
    """``total_rows, total_size_bytes, columns, sample_rows, summary, key_observations``.

    Without ``total_bytes`` the size is that of the rows as JSON text.
    """
    size = (
        F.lit(total_bytes).cast("bigint") if total_bytes is not None
        else F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))
    )
    listing = schema_listing(df)
    totals = df.agg(F.count(F.lit(1)).alias("total_rows"), size.alias("total_size_bytes"))
    sample = df.limit(SAMPLE_ROWS).agg(
        F.collect_list(F.to_json(F.struct("*"))).alias("sample_rows")
    )
    seen = observations(df, **options).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("weight", "position", "observation"))),
            lambda o: o["observation"],
        ).alias("key_observations")
    )
    columns = F.array(*[
        F.struct(F.lit(c["name"]).alias("name"), F.lit(c["type"]).alias("type")) for c in listing
    ])
    kinds = ", ".join(
        f"{sum(c['type'] == t for c in listing)} {t}"
        for t in dict.fromkeys(c["type"] for c in listing)
    )
    text = F.format_string(f"%d rows in {len(listing)} columns ({kinds}).", "total_rows")
    return totals.select(
        "total_rows", "total_size_bytes", columns.alias("columns"),
        sample.scalar().alias("sample_rows"), text.alias("summary"),
        seen.scalar().alias("key_observations"),
    )
