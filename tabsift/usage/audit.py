"""Audit log: typed rows, one per event, stored by month; and the answer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.functions.contracts import valid_messages
from tabsift.operators.joins import keyed_join
from tabsift.operators.ranking import first_wins
from tabsift.operators.trees import canonical_hash


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_MM")


def month_bounds(ts: Column) -> Column:
    """``struct(start, end, name)`` of the month partition a time belongs to."""
    start = F.date_trunc("month", ts)
    return F.struct(
        start.alias("start"), F.add_months(start, 1).alias("end"),
        F.concat(F.lit("audit_log_"), month_of(ts)).alias("name"),
    )


def audit_rows(events: DataFrame) -> DataFrame:
    """Adds ``month``; repeated events keep their first arrival."""
    single = first_wins(events, ["event_id"], ["created_at"])
    return single.withColumn("month", month_of(F.col("created_at")))


def audit_rows_from_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Valid audit messages as log rows; invalid ones are left out."""
    rows = valid_messages(messages, value, "audit-events").select(
        "event_id", "user_id", "action", "target",
        F.to_json("metadata").alias("metadata"), F.col("occurred_at").alias("created_at"),
    )
    return rows.withColumn("month", month_of(F.col("created_at")))


def write_audit(rows: DataFrame, path: str) -> None:
    """Append to the log; readers that filter on ``month`` touch only those folders."""
    # Rebalancing gathers a small month into few files and splits a huge one over many tasks.
    rows.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def answer_cache(
    requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 3600
) -> DataFrame:
    """Adds ``cache_key, answer, hit`` to ``capability, payload`` requests.

    Payloads that differ in key order or spacing share a key; an answer older than the time to
    live is no hit.
    """
    alive = cache.filter(
        F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))
    )
    newest = alive.groupBy(F.col("capability").alias("_c"), F.col("cache_key").alias("_k")).agg(
        F.max_by("answer", "stored_at").alias("answer")
    )
    keyed = requests.withColumn("cache_key", canonical_hash(F.col("payload")))
    found = keyed_join(keyed, newest, {"capability": "_c", "cache_key": "_k"}, "left")
    return found.select(keyed["*"], "answer", F.col("answer").isNotNull().alias("hit"))
