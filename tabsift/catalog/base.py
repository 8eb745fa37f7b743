"""Registry of runnable queries and the views on the driver tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(column: Column | str, digits: int = 4) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits)


def as_long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# ---- stand-ins for the usage tables -----------------------------------------------------------

# The same views in SQL, for the oracle.
SQL_SUBSCRIPTIONS = """
subscriptions AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'paid' ELSE 'free' END AS tier,
         CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'cancelled'
              ELSE 'past_due' END AS status,
         o_orderdate AS started_at,
         CASE WHEN o_totalprice <= 250000 THEN o_orderdate + INTERVAL 1095 DAY END AS expires_at
  FROM orders)"""

NOW_SUBS = "2000-06-01 00:00:00"

SQL_TIERS = SQL_SUBSCRIPTIONS + f""",
latest_subs AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS rn
    FROM subscriptions WHERE status = 'active') WHERE rn = 1),
tiers AS (
  SELECT user_id, CASE WHEN expires_at IS NULL OR expires_at > TIMESTAMP '{NOW_SUBS}'
                       THEN tier ELSE 'free' END AS tier
  FROM latest_subs)"""

SQL_REQUESTS = """
requests AS (
  SELECT event_id, user_id, ts,
         CASE event_type WHEN 'signup' THEN '/api/v1/auth/signup'
              WHEN 'click' THEN '/api/v1/uploads/new'
              WHEN 'view' THEN '/api/v1/ai/summary'
              WHEN 'purchase' THEN '/api/v1/recipes/run'
              ELSE '/api/v1/format-requests' END AS path,
         'POST' AS method,
         '10.0.0.' || CAST(user_id // 10 AS VARCHAR) AS ip,
         CAST(floor(value * 1048576) AS BIGINT) AS size_bytes
  FROM events)"""

SQL_JOB_EVENTS = """
job_events AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS job_id, event_id, ts,
         CASE event_type WHEN 'signup' THEN 'running' WHEN 'click' THEN 'running'
              WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'cancelled'
              ELSE 'failed' END AS status,
         CASE WHEN event_type = 'view' THEN 'results/' || CAST(event_id AS VARCHAR) END
           AS result_ref,
         CASE WHEN event_type = 'error' THEN props END AS error
  FROM events)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(
        F.col("o_orderstatus") == "P", "cancelled").otherwise("past_due")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "paid").otherwise("free")
        .alias("tier"),
        status.alias("status"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_totalprice") <= 250000,
               F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1095))).alias("expires_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")
    )


def requests(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    path = (
        F.when(kind == "signup", "/api/v1/auth/signup").when(kind == "click", "/api/v1/uploads/new")
        .when(kind == "view", "/api/v1/ai/summary").when(kind == "purchase", "/api/v1/recipes/run")
        .otherwise("/api/v1/format-requests")
    )
    return events.select(
        "event_id", "user_id", "ts", path.alias("path"), F.lit("POST").alias("method"),
        F.concat(F.lit("10.0.0."), F.expr("user_id div 10").cast("string")).alias("ip"),
        F.floor(F.col("value") * 1048576).cast("bigint").alias("size_bytes"),
    )


def job_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("signup", "click"), "running").when(kind == "view", "completed")
        .when(kind == "purchase", "cancelled").otherwise("failed")
    )
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
        .alias("job_id"),
        "event_id", "ts", status.alias("status"),
        F.when(kind == "view", F.concat(F.lit("results/"), F.col("event_id").cast("string")))
        .alias("result_ref"),
        F.when(kind == "error", F.col("props")).alias("error"),
    )
