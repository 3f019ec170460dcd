"""Aggregations over state and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import dates, status, text
from parcelflow.operators.dedup import latest_event


def status_counts(properties: DataFrame, only_off_map: bool = False) -> DataFrame:
    rows = properties.where(status.off_map(F.col("status"))) if only_off_map else properties
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stale(as_of: str, days: int = 14) -> Column:
    return F.col("last_seen_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def left_out(properties: DataFrame, events: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """properties with the reasons for which the live map leaves them out.

    off_map: by status; the others hold only for rows that are not: missing_coords, disappeared (of those with coordinates)
    and stale. duplicate: it is the hidden side of a link, whatever else.
    """
    gone = latest_event(events).where(F.col("event_type") == "disappeared").select("auction_id", F.lit(True).alias("_gone"))
    dup = links.select("property_id", F.lit(True).alias("_dup")).distinct()
    off = status.off_map(F.col("status"))
    blind = F.col("latitude").isNull() | F.col("longitude").isNull()
    return properties.join(gone, "auction_id", "left").join(dup, "property_id", "left").select(
        *properties.columns, off.alias("off_map"), (~off & blind).alias("missing_coords"), (~off & ~blind & F.coalesce("_gone", F.lit(False))).alias("disappeared"), (~off & F.coalesce(stale(as_of), F.lit(False))).alias("stale"), F.coalesce("_dup", F.lit(False)).alias("duplicate")
    )


def exclusion_accounting(properties: DataFrame, events: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """One row of counts: total, exported, excluded_total, each reason of left_out() (they may overlap), and by_status, a
    breakdown 'status=n, ...' of the statuses that leave the map."""
    rows = left_out(properties, events, links, as_of)
    shown = ~(F.col("off_map") | F.col("missing_coords") | F.col("disappeared") | F.col("stale") | F.col("duplicate"))
    reasons = ("missing_coords", "duplicate", "disappeared", "stale")
    per = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(shown).alias("exported"), F.bool_or("off_map").alias("off"), *(F.count_if(r).alias(r) for r in reasons))
    part = F.when(F.col("off"), F.concat("status", F.lit("="), F.col("n").cast("string")))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("exported"), F.lit(0)).alias("exported"), F.coalesce(F.sum(F.col("n") - F.col("exported")), F.lit(0)).alias("excluded_total"),
        F.array_join(F.array_sort(F.collect_list(part)), ", ").alias("by_status"), *(F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in reasons),
    )  # a row a status


def postponements(events: DataFrame) -> DataFrame:
    """Date changes of each auction, and the date before the first."""
    return events.where(F.col("event_type") == "date_change").groupBy("auction_id").agg(F.count(F.lit(1)).alias("times_postponed"), F.min_by("old_value", "event_id").alias("original_date"))


def pdf_links(rows: DataFrame, links: str = "pdf_links") -> DataFrame:
    """(property_id, ord, link): links split at semicolons, trimmed, blanks left out."""
    parts = F.filter(F.transform(F.split(links, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("property_id", F.posexplode(parts).alias("ord", "link"))


def run_summary(found: DataFrame, events: DataFrame) -> DataFrame:
    """Counters of each run as its events tell them, beside the rows that were found; a load's own row has the others."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return events.groupBy("run_id").agg(kind("first_seen").alias("new"), F.countDistinct(F.when(F.col("event_type").isin("status_change", "date_change"), F.col("auction_id"))).alias("changed"), kind("disappeared").alias("removed")).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("found"))))  # found is one row


def change_sections(events: DataFrame, properties: DataFrame | None, run_id: int) -> DataFrame:
    """A run's events with the address of their property; properties is None where the events have it."""
    kinds = ("first_seen", "status_change", "date_change", "disappeared")
    rows = events.where((F.col("run_id") == run_id) & F.col("event_type").isin(*kinds))
    if properties is not None:
        rows = rows.join(properties.select("auction_id", "address"), "auction_id")
    return rows.select("event_type", "address", "event_id", "old_value", "new_value")


def seasoned(as_of: str, days: int = 7) -> Column:
    """False only for auctions over days out that have been seen for less than days; nulls count as seasoned."""
    now = F.lit(as_of).cast("timestamp_ntz")
    far = F.col("auction_datetime") > now + F.make_dt_interval(F.lit(days))
    new = F.col("last_seen_at") < F.col("first_seen_at") + F.make_dt_interval(F.lit(days))
    return F.coalesce(~(far & new), F.lit(True))


def is_removal() -> Column:
    return (F.col("event_type") == "disappeared") | ((F.col("event_type") == "status_change") & status.terminal(F.col("new_value")))


def change_label() -> Column:
    dash = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("—"))
    arrow = F.concat(dates.date_only(F.col("old_value")), F.lit(" → "), dates.date_only(F.col("new_value")))
    return F.when(F.col("event_type") == "date_change", arrow).otherwise(F.concat("event_type", F.lit(": "), dash(F.col("new_value"))))


def change_groups(changes: DataFrame, as_of: str, keys: tuple[str, ...] = ("address",)) -> DataFrame:
    """Changes of a window put together by address: category, ordered distinct labels, and when the removal was seen.

    The newest event (highest id on ties) is the group's first; unseasoned groups and those that are new and removed at
    once are left out. Labels come newest first. All parts are aggregates over the group with map-side combine.
    """
    newest = F.struct("detected_at", "event_id")
    removal = is_removal()
    noise = (F.col("event_type") == "status_change") & ~status.terminal(F.col("new_value"))
    shown = (F.col("event_type") != "first_seen") & ~removal & ~noise
    label = F.when(shown, F.struct((-F.unix_micros(F.col("detected_at").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("i"), change_label().alias("label")))
    kept = [c for c in ("property_id", "url", "auction_datetime", "first_seen_at", "last_seen_at", "property_status", "latitude", "longitude") if c in changes.columns]
    grouped = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*kept), newest).alias("f"), F.bool_or(F.col("event_type") == "first_seen").alias("was_new"), F.bool_or(removal).alias("was_removed"),
        F.bool_or(F.col("event_type").isin("date_change", "price_change")).alias("other"), F.bool_or(F.col("event_type") == "date_change").alias("dated"),
        F.max(F.when(removal, F.col("detected_at"))).alias("removed_at"), F.array_distinct(F.transform(F.array_sort(F.collect_list(label)), lambda x: x["label"])).alias("labels"),
    ).select(*keys, "f.*", "was_new", "was_removed", "other", "dated", "removed_at", "labels")
    grouped = grouped.where(seasoned(as_of) & ~(F.col("was_new") & F.col("was_removed")))
    labels = F.when(F.col("was_removed"), F.array(F.lit("Removed"))).when(F.col("was_new") & ~F.col("other"), F.array(F.lit("New"))).when(F.col("was_new"), F.concat(F.array(F.lit("New")), "labels")).otherwise(F.col("labels"))
    category = F.when(F.col("was_removed"), "Removed").when(F.col("was_new") & ~F.col("other"), "New").when(F.col("dated"), "Date Changes").otherwise("Status Changes")
    rank = F.array_position(F.array(*map(F.lit, ("New", "Date Changes", "Status Changes", "Removed"))), F.col("category"))
    return grouped.withColumn("category", category).withColumn("labels", labels).where(F.size("labels") > 0).withColumn("category_rank", rank).drop("was_new", "was_removed", "other", "dated")


def extraction_stats(rows: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Cache hits, misses and the estimated cost of the misses."""
    have = cache.select("id", "digest", F.lit(True).alias("_hit")).distinct()
    marked = rows.withColumn("digest", F.sha2(F.col(text_col), 256)).join(have, ["id", "digest"], "left")
    return marked.agg(F.count_if("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"), F.round(F.sum(F.when(F.col("_hit").isNull(), text.extraction_cost(F.col(text_col))).otherwise(0.0)), 6).alias("cost"))


def last_sent(notifications: DataFrame) -> DataFrame:
    """Last send of each email, and of each email and kind (kind is null in the former)."""
    return notifications.groupingSets([["email"], ["email", "kind"]], "email", "kind").agg(F.max("sent_at").alias("last_sent"))


def sent_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("email", "kind").agg(F.count(F.lit(1)).alias("sent"))


def ever_sent(people: DataFrame, notifications: DataFrame, kind: str) -> DataFrame:
    """people with how many of a kind each was sent, and whether any."""
    sent = notifications.where(F.col("kind") == kind).groupBy("email").agg(F.count(F.lit(1)).alias("sent"))
    return people.join(sent, "email", "left").withColumn("sent", F.coalesce("sent", F.lit(0).cast("long"))).withColumn("ever_sent", F.col("sent") > 0)


def digest_counts(upcoming: DataFrame, events: DataFrame, properties: DataFrame, removed: DataFrame) -> DataFrame:
    """A digest's counts and subject: upcoming rows, new listings and postponements among the events of known properties, removed rows."""
    known = events.join(properties.select("auction_id"), "auction_id", "left_semi")
    kinds = known.agg(F.count_if(F.col("event_type") == "first_seen").alias("n_new"), F.count_if((F.col("event_type") == "status_change") & (F.lower("new_value") == "postponed")).alias("n_postponed"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = count(upcoming, "n_upcoming").join(kinds).join(count(removed, "n_cancelled"))  # one row each
    told = F.concat(F.lit("Auction watch: "), F.col("n_upcoming").cast("string"), F.lit(" auction(s) this week"))
    return rows.withColumn("subject", F.concat(told, F.when(F.col("n_cancelled") > 0, F.concat(F.lit(", "), F.col("n_cancelled").cast("string"), F.lit(" cancelled"))).otherwise("")))


def sources_present(rows: DataFrame, key: Column) -> DataFrame:
    return rows.withColumn("_key", key).where(F.col("_key").isNotNull()).groupBy("_key").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))
