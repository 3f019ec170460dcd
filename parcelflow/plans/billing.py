"""Billing events in batch form: each applied once, folded into subscription states and invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.operators.joins import billing_to_subscriber


def once(events: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Redelivered events once, the first delivery; events of the log not at all."""
    fields = [c for c in events.columns if c != "event_id"]
    out = events.groupBy("event_id").agg(F.min_by(F.struct(*fields), "seq").alias("e")).select("event_id", *(F.col(f"e.{c}").alias(c) for c in fields))
    return out if log is None else out.join(log.select("event_id"), "event_id", "left_anti")


def subscription_state(events: DataFrame) -> DataFrame:
    """The last status of each subscription: checkout makes it active, an update gives it, a deletion ends it."""
    status = F.when(F.col("kind") == "checkout", "active").when(F.col("kind") == "deleted", "canceled").otherwise(F.col("status"))
    rows = once(events).where(F.col("kind").isin("checkout", "updated", "deleted")).withColumn("status", status)
    return rows.groupBy("subscription_id").agg(F.max_by("status", F.struct("event_time", "event_id")).alias("subscription_status"), F.max("event_time").alias("changed_at"))


#: A subscription's part of the stored state. Times are (event_time, event_id), so events have one order whatever batch they come in.
_TIME = "struct<at:timestamp_ntz,id:bigint>"
SUBSCRIPTIONS = f"bucket string, subscription_id string, email string, first_checkout {_TIME}, last_checkout {_TIME}, subscription_status string, changed {_TIME}, deleted {_TIME}"
SUBSCRIPTION_KEYS = ("bucket", "subscription_id")
BUCKETS = 64


def bucket_of(subscription_id: Column) -> Column:
    return F.pmod(F.xxhash64(subscription_id), F.lit(BUCKETS)).cast("string")


def folded(events: DataFrame) -> DataFrame:
    """(SUBSCRIPTIONS) of events, each of which is to be applied once: subscription_id, kind, status, email, event_time, event_id.

    A checkout makes a subscription active and gives its email, an update gives its status, a deletion ends it.
    """
    time = F.struct(F.col("event_time").cast("timestamp_ntz").alias("at"), F.col("event_id").cast("long").alias("id"))
    status = F.when(F.col("kind") == "checkout", "active").when(F.col("kind") == "deleted", "canceled").otherwise(F.col("status"))
    checkout, deleted = F.col("kind") == "checkout", F.col("kind") == "deleted"
    rows = events.where(F.col("kind").isin("checkout", "updated", "deleted") & F.col("subscription_id").isNotNull()).select(
        bucket_of(F.col("subscription_id")).alias("bucket"), "subscription_id", F.when(checkout, F.col("email")).alias("email"), F.when(checkout, time).alias("first_checkout"), F.when(checkout, time).alias("last_checkout"),
        status.alias("subscription_status"), time.alias("changed"), F.when(deleted, time).alias("deleted"),
    )
    return merged(rows)


def merged(states: DataFrame) -> DataFrame:
    """One row a subscription of several parts of its state; the order of the parts does not matter."""
    return states.groupBy(*SUBSCRIPTION_KEYS).agg(
        F.max_by("email", "last_checkout").alias("email"), F.min("first_checkout").alias("first_checkout"), F.max("last_checkout").alias("last_checkout"),
        F.max_by("subscription_status", "changed").alias("subscription_status"), F.max("changed").alias("changed"), F.max("deleted").alias("deleted"),
    )


def after_billing(subscribers: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """subscribers (email, subscription_id, subscription_status, active, ...) as their subscriptions have left them.

    An email's subscription is the one that it checked out last. A deletion after a subscription's first checkout, and before the
    email's first checkout of another one, deactivates the subscriber; only a new verification makes them active again.
    Subscribers without a checkout stay as they are.
    """
    known = subscriptions.where(F.col("email").isNotNull())
    of_email = Window.partitionBy("email").orderBy("first_checkout")  # the subscriptions of one person
    ended = F.col("deleted") > F.col("first_checkout")
    later = F.lead("first_checkout").over(of_email)
    told = known.withColumn("_ended", F.coalesce(ended & (later.isNull() | (F.col("deleted") < later)), F.lit(False)))
    last = told.groupBy("email").agg(F.max_by(F.struct("subscription_id", "subscription_status"), "last_checkout").alias("_s"), F.bool_or("_ended").alias("_ended"))
    both = subscribers.join(last, "email", "left")
    new = {"subscription_id": F.coalesce("_s.subscription_id", "subscription_id"), "active": F.col("active") & ~F.coalesce("_ended", F.lit(False))}
    new["subscription_status"] = F.when(F.col("_s").isNotNull(), F.col("_s.subscription_status")).otherwise(F.col("subscription_status"))
    return both.select(*(new.get(c, F.col(c)).alias(c) for c in subscribers.columns))


def invoice_ledger(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One row per paid invoice of a known subscription, the first event of each."""
    paid = once(events).where((F.col("kind") == "invoice_paid") & F.col("subscription_id").isNotNull())
    rows = billing_to_subscriber(paid, subscribers).where(F.col("email").isNotNull())
    return rows.groupBy("invoice_id").agg(F.min_by(F.struct("email", "amount", (F.unix_seconds(F.col("event_time").cast("timestamp")) * 1000).alias("paid_ms")), F.struct("event_time", "event_id")).alias("x")).select("invoice_id", "x.*")
