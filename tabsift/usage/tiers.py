"""Tiers: subscriptions to effective tiers, tier limits and the feature gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.operators.joins import keyed_join
from tabsift.operators.ranking import latest

FREE, PAID = "free", "paid"


@dataclass(frozen=True)
class TierLimits:
    """Upload size in MB and operations per day; 0 means unlimited."""

    free_upload_mb: int = 5
    free_daily_ops: int = 100
    paid_upload_mb: int = 500
    paid_daily_ops: int = 0

    def upload_mb(self, tier: Column) -> Column:
        return F.when(tier == PAID, self.paid_upload_mb).otherwise(self.free_upload_mb)

    def daily_ops(self, tier: Column) -> Column:
        return F.when(tier == PAID, self.paid_daily_ops).otherwise(self.free_daily_ops)


def latest_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Per user the active subscription that started last: ``user_id, tier, started_at,
    expires_at``; equal starts go to the greater id."""
    active = subscriptions.filter(F.col("status") == "active")
    return latest(
        active, ["user_id"], [F.col("started_at"), F.col("id")],
        ["tier", "started_at", "expires_at"],
    )


def effective_tiers(subscriptions: DataFrame, now: Column) -> DataFrame:
    """``user_id, tier`` of users with an active subscription; an expired one counts as free."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return latest_subscriptions(subscriptions).select(
        "user_id", F.when(alive, F.col("tier")).otherwise(FREE).alias("tier")
    )


def with_tier(df: DataFrame, tiers: DataFrame, user: str = "user_id") -> DataFrame:
    """Adds ``tier``; users without a subscription are free. ``tiers`` has one row per user."""
    side = tiers.select(F.col("user_id").alias("_u"), F.col("tier").alias("_tier"))
    return keyed_join(df, side, {user: "_u"}, "left").select(
        df["*"], F.coalesce("_tier", F.lit(FREE)).alias("tier")
    )


def users_without_subscription(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Users that need a default subscription."""
    active = subscriptions.filter(F.col("status") == "active").select(
        F.col("user_id").alias("_u")
    )
    return users.join(active, users["user_id"] == active["_u"], "left_anti")


# ---- features ----------------------------------------------------------------------------------

# Path prefix to the feature it needs; the last entry applies to POST only.
FEATURE_PATHS = (
    ("/api/v1/ai/nl-to-filter", "ai-nl-to-filter"),
    ("/api/v1/ai/summary", "ai-auto-summary"),
    ("/api/v1/ai/chart-suggest", "ai-chart-suggest"),
    ("/api/v1/ai/anomaly", "ai-anomaly-detect"),
    ("/api/v1/recipes", "recipe-crud"),
)
SUBMIT_PATH, SUBMIT_FEATURE = "/api/v1/format-requests", "format-request-submit"
REJECT_FEATURE = "FEATURE_REQUIRES_PAID_TIER"


def feature_of(path: Column, method: Column) -> Column:
    """The gated feature a request uses, or null."""
    out = F.when((path == SUBMIT_PATH) & (method == "POST"), SUBMIT_FEATURE)
    for prefix, feature in FEATURE_PATHS:
        out = out.when(path.startswith(prefix), feature)
    return out


def version_key(version: Column) -> Column:
    """A dotted version as numbers, so 1.10 is later than 1.9."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def latest_plugins(registry: DataFrame) -> DataFrame:
    """Latest enabled version per plugin: ``plugin_id, version, required_tier``."""
    enabled = registry.filter(F.col("status") == "enabled")
    return latest(
        enabled, ["plugin_id"], [version_key(F.col("version")), F.col("version")],
        ["version", "required_tier"],
    )


def feature_gate(requests: DataFrame, registry: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds ``tier, required_tier, allowed`` to requests that carry ``user_id, plugin_id``.

    A feature that is unknown or needs no paid tier is open to all.
    """
    needed = latest_plugins(registry).select(
        F.col("plugin_id").alias("_p"), F.col("required_tier").alias("required_tier")
    )
    seen = with_tier(requests, tiers)
    joined = keyed_join(seen, needed, {"plugin_id": "_p"}, "left").drop("_p")
    refused = F.coalesce(F.col("required_tier") == PAID, F.lit(False)) & (F.col("tier") != PAID)
    return joined.withColumn("allowed", ~refused)


def owned(items: DataFrame, requested: DataFrame) -> DataFrame:
    """Items whose ``(id, user_id)`` was asked for: only the owner finds them."""
    return items.join(requested.select("id", "user_id"), ["id", "user_id"], "left_semi")
