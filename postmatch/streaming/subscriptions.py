"""Subscription commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import active_subscribers

# --- fixed values: commands and menu texts ---
STATUS_TEXTS = ["🔔 Subscription Status", "Subscription Status", "Subscription"]
# --- end of fixed values ---


def _command(name: str):
    return F.col("text").rlike(rf"^/{name}(?:@\w+)?(?:\s|$)")


def subscription_actions(updates: DataFrame) -> DataFrame:
    """Log rows (user_id, action, ts) of subscribe and unsubscribe commands; works on tables and streams."""
    action = F.when(_command("subscribe"), "add").when(_command("unsubscribe"), "remove")
    return (
        updates.where((F.col("kind") == "msg") & F.col("user_id").isNotNull())
        .select("user_id", action.alias("action"), "ts")
        .where(F.col("action").isNotNull())
    )


def subscription_status(updates: DataFrame, log: DataFrame) -> DataFrame:
    """Rows (user_id, ts, subscribed) answering status requests against the current state of the log."""
    asked = updates.where(
        (F.col("kind") == "msg")
        & F.col("user_id").isNotNull()
        & (_command("subscription") | F.col("text").isin(STATUS_TEXTS))
    )
    current = active_subscribers(log).withColumn("subscribed", F.lit(True))
    return asked.join(current, "user_id", "left").select(
        "user_id", "ts", F.coalesce("subscribed", F.lit(False)).alias("subscribed")
    )
