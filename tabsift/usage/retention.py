"""Retention: which stored objects and records are due, by owner tier and age."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.usage.tiers import PAID, with_tier

UPLOADS, RESULTS = "uploads", "results"


@dataclass(frozen=True)
class RetentionRules:
    upload_free_hours: int = 24
    upload_paid_days: int = 30
    result_free_hours: int = 24
    result_paid_days: int = 30

    def keep_for(self, bucket: Column, tier: Column) -> Column:
        """Age an object may reach, as an interval."""

        def hours(n: int) -> Column:
            return F.make_dt_interval(hours=F.lit(n))

        upload = F.when(tier == PAID, hours(24 * self.upload_paid_days)).otherwise(
            hours(self.upload_free_hours)
        )
        result = F.when(tier == PAID, hours(24 * self.result_paid_days)).otherwise(
            hours(self.result_free_hours)
        )
        return F.when(bucket == RESULTS, result).otherwise(upload)


def owner_of(key: Column) -> Column:
    """The owner in ``users/<owner>/…``, else the first segment, else ``unknown``."""
    under_users = F.regexp_extract(key, r"^users/([^/]+)/", 1)
    return (
        F.when(under_users != "", under_users)
        .when(key.contains("/"), F.split_part(key, F.lit("/"), F.lit(1)))
        .otherwise("unknown")
    )


def blob_key(path: Column, root: str) -> Column:
    """Key of a listed path below its bucket's root."""
    return F.regexp_replace(path, f"^.*?{root.strip('/')}/", "")


def extension_of(key: Column) -> Column:
    return F.lower(F.regexp_extract(key, r"\.([^./]+)$", 1))


def listing(uploads: DataFrame, results: DataFrame) -> DataFrame:
    """Both buckets as one table: ``bucket, key, last_modified``."""

    def side(df: DataFrame, bucket: str) -> DataFrame:
        return df.select(F.lit(bucket).alias("bucket"), "key", "last_modified")

    return side(uploads, UPLOADS).unionByName(side(results, RESULTS))


def sweep_plan(
    blobs: DataFrame, tiers: DataFrame, now: Column, rules: RetentionRules = RetentionRules()
) -> DataFrame:
    """``bucket, key, last_modified, owner_id, tier, cutoff, expired`` for every object.

    An object is due when it is strictly older than its cutoff. Blobs may bring their own
    ``owner_id``.
    """
    owned = blobs if "owner_id" in blobs.columns else blobs.withColumn(
        "owner_id", owner_of(F.col("key"))
    )
    seen = with_tier(owned, tiers, "owner_id")
    cutoff = now - rules.keep_for(F.col("bucket"), F.col("tier"))
    return seen.withColumn("cutoff", cutoff).withColumn(
        "expired", F.col("last_modified") < F.col("cutoff")
    )


def deletion_manifest(plan: DataFrame) -> DataFrame:
    return plan.filter("expired").select("bucket", "key", "owner_id", "tier", "last_modified")


def sweep_counts(plan: DataFrame) -> DataFrame:
    """``bucket, scanned, deleted, retained`` per bucket and, with a null bucket, in total."""
    return plan.rollup("bucket").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("expired")).alias("deleted"),
        F.count_if(~F.col("expired")).alias("retained"),
    )


def record_lifecycle(
    records: DataFrame, now: Column, ts: str = "created_at", hot_days: int = 90,
    archive_days: int | None = None, tier: str | None = None,
) -> DataFrame:
    """Adds ``stage``: ``hot``, then ``archive`` (or ``expired`` without an archive).

    With a ``tier`` column paid records stay hot for good.
    """
    age = now - F.make_dt_interval(days=F.lit(hot_days))
    gone = F.lit("expired")
    if archive_days is not None:
        end = now - F.make_dt_interval(days=F.lit(hot_days + archive_days))
        gone = F.when(F.col(ts) >= end, "archive").otherwise("expired")
    hot = F.col(ts) >= age
    if tier:
        hot = hot | (F.col(tier) == PAID)
    return records.withColumn("stage", F.when(hot, "hot").otherwise(gone))
