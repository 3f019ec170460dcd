"""Joins of properties, events, caches and subscribers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.text import haversine_m, house_number, house_street
from parcelflow.functions.udf import street_similarity
from parcelflow.operators.dedup import latest_event
from parcelflow.sources.files import kept


def current_listings(properties: DataFrame, auctions: DataFrame) -> DataFrame:
    """Each property with its current auction."""
    return properties.join(auctions, "property_id")


def events_with_property(events: DataFrame, properties: DataFrame) -> DataFrame:
    return events.join(properties.withColumnRenamed("status", "property_status"), "auction_id")


def hide_duplicates(properties: DataFrame, links: DataFrame | None) -> DataFrame:
    return properties if links is None else properties.join(links.select("property_id"), "property_id", "left_anti")


def drop_if_last_disappeared(properties: DataFrame, events: DataFrame) -> DataFrame:
    gone = latest_event(events).where(F.col("event_type") == "disappeared").select("auction_id")
    return properties.join(gone, "auction_id", "left_anti")


#: Degrees of a grid cell, as a multiple of the box: few points are near an edge, and a cell holds few points of one house number.
CELL = 4


def near_pairs(a: DataFrame, b: DataFrame, box: float, on: Sequence[str]) -> DataFrame:
    """Rows of a and b, whose columns begin with a_ and b_, within a box of latitude and longitude and equal in on; each pair once.

    Each row of a is in the cell of its point, each of b in all cells that the box around its point meets, so a join on the
    cell finds every pair. Cells are wider than boxes: most points have one, and none has more than four.
    """
    step = box * CELL
    cell = lambda c: F.floor(c / step)
    slack = box * 1.001  # wider than the box by more than the rounding of a cell's number
    cells = lambda c: F.explode(F.sequence(cell(F.col(c) - slack), cell(F.col(c) + slack)))
    left = a.withColumns({"x": cell(F.col("a_latitude")), "y": cell(F.col("a_longitude"))})
    right = b.withColumn("x", cells("b_latitude")).withColumn("y", cells("b_longitude"))
    equal = [left[f"a_{c}"] == right[f"b_{c}"] for c in on]
    within = (F.abs(F.col("a_latitude") - F.col("b_latitude")) <= box) & (F.abs(F.col("a_longitude") - F.col("b_longitude")) <= box)
    joined = left.join(right, [left["x"] == right["x"], left["y"] == right["y"], *equal]).where(within).drop("x", "y")
    dist = haversine_m(*(F.col(c) for c in ("a_latitude", "a_longitude", "b_latitude", "b_longitude")))
    return joined.withColumn("metres", dist)


def points(properties: DataFrame, *others: Column) -> DataFrame:
    """(property_id, source, latitude, longitude, house, street) of properties with a house number and a point, and others."""
    pts = properties.select("property_id", "source", "latitude", "longitude", house_number(F.col("address")).alias("house"), house_street(F.col("address")).alias("street"), *others)
    return pts.where(F.col("house").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def point_pairs(pts: DataFrame, box: float = 0.0015, metres: float = 100.0, on: Sequence[str] = ("house",)) -> DataFrame:
    """Pairs of points() of different sources within a box and a distance that are equal in on, the lower id as a."""
    side = lambda p: pts.select(*(F.col(c).alias(f"{p}_{c}") for c in pts.columns))
    pairs = near_pairs(side("a"), side("b"), box, on)
    return pairs.where((F.col("a_property_id") < F.col("b_property_id")) & (F.col("a_source") != F.col("b_source")) & (F.col("metres") <= metres))


def proximity_pairs(properties: DataFrame, box: float = 0.0015, metres: float = 100.0) -> DataFrame:
    """Pairs of different sources within a box and a distance with one house number; candidates by grid cells, never by pairs of all.

    Streets and house numbers are read once and kept, both sides of the pairs are read from there.
    """
    return point_pairs(kept(points(properties), "points"), box, metres)


def similar_pairs(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    return pairs.withColumn("similarity", street_similarity("a_street", "b_street")).where(F.col("similarity") >= least)


def geocode_resolve(rows: DataFrame, overrides: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates by override, else by the address cache; resolved_by is null where neither has the row."""
    o = overrides.select("id", F.col("latitude").alias("_olat"), F.col("longitude").alias("_olon"))
    c = cache.select("address", F.col("latitude").alias("_clat"), F.col("longitude").alias("_clon"))
    out = rows.drop("latitude", "longitude").join(o, "id", "left").join(c, "address", "left")
    return out.withColumn("latitude", F.coalesce("_olat", "_clat")).withColumn("longitude", F.coalesce("_olon", "_clon")).withColumn("resolved_by", F.when(F.col("_olat").isNotNull(), "override").when(F.col("_clat").isNotNull(), "cache")).drop("_olat", "_olon", "_clat", "_clon")


def apply_geocodes(rows: DataFrame, batch: DataFrame, single: DataFrame) -> DataFrame:
    b = batch.select("address", F.col("latitude").alias("_b1"), F.col("longitude").alias("_b2"))
    s = single.select("address", F.col("latitude").alias("_s1"), F.col("longitude").alias("_s2"))
    out = rows.drop("latitude", "longitude").join(b, "address", "left").join(s, "address", "left")
    return out.withColumn("latitude", F.coalesce("_b1", "_s1")).withColumn("longitude", F.coalesce("_b2", "_s2")).drop("_b1", "_b2", "_s1", "_s2")


def extend_cache(cache: DataFrame, *found: DataFrame) -> DataFrame:
    """The cache with the found addresses; what it has already stays, then the earlier result set wins."""
    cols = ["address", "latitude", "longitude"]
    every = cache.select(*cols, F.lit(0).alias("_o"))
    for i, f in enumerate(found, 1):
        every = every.unionByName(f.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(*cols, F.lit(i).alias("_o")))
    return every.groupBy("address").agg(F.min_by(F.struct("latitude", "longitude"), "_o").alias("x")).select("address", "x.latitude", "x.longitude")


def detail_fetch_list(rows: DataFrame, cache: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """Rows whose detail is missing or older than days."""
    fresh = cache.where(F.col("scraped_at") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))).select("id")
    return rows.join(fresh, "id", "left_anti")


def changed_text(rows: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose (id, digest of text) is not cached."""
    return rows.withColumn("digest", F.sha2(F.col(text), 256)).join(cache.select("id", "digest"), ["id", "digest"], "left_anti")


def postponed_with_new_date(events: DataFrame) -> DataFrame:
    moved = events.where((F.col("event_type") == "status_change") & (F.lower("new_value") == "postponed"))
    dates = events.where(F.col("event_type") == "date_change").groupBy("auction_id", "run_id").agg(F.min_by("new_value", "event_id").alias("new_date"))
    return moved.join(dates, ["auction_id", "run_id"], "left")


def removed_gate(removed: DataFrame, notifications: DataFrame) -> DataFrame:
    """Removals (email, removed_at) that come after the subscriber's first notification."""
    first = notifications.groupBy("email").agg(F.min("sent_at").alias("first_sent"))
    return removed.join(first, "email").where(F.col("first_sent") < F.col("removed_at")).drop("first_sent")


def saved_changes(saved: DataFrame, events: DataFrame, notifications: DataFrame, as_of: str, days: int = 8) -> DataFrame:
    """Changes of saved properties since the subscriber's last alert, else of the last days."""
    since = notifications.where(F.col("kind") == "saved").groupBy("email").agg(F.max("sent_at").alias("_since"))
    kept = events.where(F.col("event_type").isin("date_change", "disappeared", "status_change")).withColumnRenamed("auction_id", "property_id")
    start = F.coalesce("_since", F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
    return saved.join(kept, "property_id").join(since, "email", "left").where(F.col("detected_at") > start).drop("_since")


def fan_out(subscriber_states: DataFrame, rows: DataFrame) -> DataFrame:
    return subscriber_states.join(rows, "state")


#: Bytes of rows up to which they are sent to every task, and people of one key that one task is to have.
SENT_BYTES, EACH = 8 << 20, 100_000


def measured_bytes(rows: DataFrame) -> int:
    """About the bytes of all rows: those of strings as they are, 8 for any other value."""
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8) for f in rows.schema.fields), F.lit(8))
    return rows.agg(F.sum(size)).first()[0] or 0


def skewed_fan_out(people: DataFrame, rows: DataFrame, key: str = "state", sent_bytes: int = SENT_BYTES, each: int = EACH) -> DataFrame:
    """people joined with the rows of their key, where a key may hold most of the people.

    Rows of a small measured size go to every task. Else the people of a key are dealt to as many parts as their number needs,
    and the key's rows are repeated for each part, so what is repeated grows with the people of a key over each.
    """
    if measured_bytes(rows) <= sent_bytes:
        return people.join(F.broadcast(rows), key)
    parts = people.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("_parts"))
    cols = [c for c in people.columns if c != key]
    dealt = people.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(*cols), F.col("_parts")).cast("int")).drop("_parts")
    repeated = rows.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"]).drop("_part")


def fan_out_counts(subscriber_states: DataFrame, eligible: DataFrame, rows: DataFrame) -> DataFrame:
    """(state, n): rows of fan_out() for eligible subscribers (subscriber_id), from one count a state on each side."""
    people = subscriber_states.join(eligible.select("subscriber_id"), "subscriber_id", "left_semi").groupBy("state").agg(F.count(F.lit(1)).alias("people"))
    counts = rows.groupBy("state").agg(F.count(F.lit(1)).alias("listings"))
    return people.join(counts, "state").select("state", (F.col("people") * F.col("listings")).alias("n"))


def billing_to_subscriber(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Events with their subscriber's email; it is null where no subscription fits."""
    return events.join(subscribers.select("subscription_id", "email"), "subscription_id", "left")


def save_property(saved: DataFrame, requests: DataFrame, eligible: DataFrame, properties: DataFrame, as_of: str, fields: tuple[str, ...] = ("address", "state", "status", "auction_datetime", "url")) -> DataFrame:
    """saved with the requests (email, property_id) of eligible subscribers for known properties that it lacks.

    A new row is a snapshot of the property's fields with the time; rows that are saved already stay as they are.
    """
    new = requests.select("email", "property_id").distinct().join(eligible.select("email").distinct(), "email", "left_semi").join(saved, ["email", "property_id"], "left_anti")
    shot = new.join(properties.select("property_id", *fields), "property_id").withColumn("saved_at", F.lit(as_of).cast("timestamp_ntz"))
    return saved.unionByName(shot, allowMissingColumns=True)


def forget_property(saved: DataFrame, requests: DataFrame) -> DataFrame:
    return saved.join(requests, ["email", "property_id"], "left_anti")


def next_ids(rows: DataFrame, order: str, start: int, name: str) -> DataFrame:
    """rows with ids from start + 1 in an order, dealt by ranges: no single task numbers all rows."""
    return placed(rows, [F.col(order)]).withColumn("place", (F.lit(start + 1) + F.col("place")).cast("long")).withColumnRenamed("place", name)


def placed(rows: DataFrame, order: Sequence[Column], **which: Column) -> DataFrame:
    """rows with place, the number of rows before in an order, and under each name the number of all rows for which its condition holds.

    Rows are dealt by ranges, and written before they are counted, so that a task that runs twice cannot deal them otherwise.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_at")), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(c).alias(n) for n, c in which.items()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = kept(sizes.select("_part", before.alias("_base"), *(F.sum(n).over(Window.partitionBy()).alias(n) for n in which)), "ranges")
    return ranged.join(F.broadcast(base), "_part").withColumn("place", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")  # base has a row a partition
