"""Digests: upcoming listings, changes, saved-property alerts, for all subscribers at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import dates, status, text
from parcelflow.operators import aggregates
from parcelflow.operators.joins import drop_if_last_disappeared, events_with_property, fan_out, hide_duplicates, removed_gate, saved_changes, skewed_fan_out
from parcelflow.operators.thresholds import threshold_top
from parcelflow.sources.files import kept

FAR_DAYS, NEAR_DAYS, LINK_DAYS, SHOWN = 30, 7, 21, 5
#: People for whom one task is enough to fan out rows.
PEOPLE = 10_000


def at(as_of: str, days: int = 0) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(F.lit(days))


def in_states(df: DataFrame, states: Sequence[str] | None) -> DataFrame:
    return df if not states else df.where(F.col("state").isin(*states))


def find_active(properties: DataFrame, events: DataFrame, links: DataFrame | None, since: str, states: Sequence[str] | None = None) -> DataFrame:
    rows = in_states(properties.where(F.col("auction_datetime") >= at(since)), states)
    return drop_if_last_disappeared(hide_duplicates(rows, links), events)


def find_upcoming(properties: DataFrame, events: DataFrame, links: DataFrame | None, since: str, days: int, states: Sequence[str] | None = None) -> DataFrame:
    return find_active(properties, events, links, since, states).where(F.col("auction_datetime") <= at(since, days))


def find_recent_changes(events: DataFrame, properties: DataFrame, links: DataFrame | None, since: str, states: Sequence[str] | None = None) -> DataFrame:
    rows = events_with_property(events.where(F.col("detected_at") >= at(since)), hide_duplicates(in_states(properties, states), links))
    return rows.where(~(F.col("auction_datetime").isNull() & F.coalesce(F.col("property_status").isin(*status.DATELESS_TERMINAL), F.lit(False))))


def filter_active(listings: DataFrame, as_of: str) -> DataFrame:
    dt = F.col("auction_datetime")
    return listings.where(dt.isNotNull() & ~status.terminal(F.col("status")) & (dt < at(as_of, FAR_DAYS)) & (aggregates.seasoned(as_of) | (dt < at(as_of, NEAR_DAYS))))


def link_available(as_of: str) -> Column:
    return F.coalesce(F.col("auction_datetime") < at(as_of, LINK_DAYS), F.lit(False))


SHOWN_FIELDS = ("email", "section", "rank", "more", "state", "property_id", "address", "auction_datetime", "labels", "url", "latitude", "longitude")
FIELDS = ("state", "property_id", "address", "auction_datetime", "url", "latitude", "longitude", "labels")
#: Upcoming rows go by date, changes by address; the other one is null.
ORDER = ("by_date", "by_address", "property_id")


def first_rows(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key in ORDER, with rank; the ranking is cut before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER))).where(F.col("rank") <= n)


def first_of_states(people: DataFrame, rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """rows as each person (email) of people (email, state) sees them: the first n of each section over all states of the person, with rank and
    more, which is what is left.

    Ranked and counted once for each set of states that somebody has, cut to n a state before; people of one set get the same rows, unsorted.
    """
    sets = kept(people.groupBy("email").agg(F.to_json(F.sort_array(F.collect_set("state"))).alias("_states")), "state-sets")
    each = sets.select("_states").distinct().withColumn("state", F.explode(F.from_json("_states", "array<string>")))
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    first = kept(ranked(rows, "state", "section").drop("rank"), "first-rows")
    counts = rows.groupBy("state", "section").agg(F.count(F.lit(1)).alias("_n"))
    totals = fan_out(each, counts).groupBy("_states", "section").agg(F.sum("_n").alias("_n"))
    shown = ranked(skewed_fan_out(each, first), "_states", "section").join(totals, ["_states", "section"])
    seen = kept(shown.withColumn("more", F.greatest(F.col("_n") - n, F.lit(0))).drop("_n"), "seen")
    tasks = min(-(-sets.count() // PEOPLE), int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # the count is in the files' footers
    return skewed_fan_out(sets.repartition(max(tasks, 1), "email"), seen, "_states").drop("_states")


def minutes(time: Column, since: str, step: int) -> Column:
    """Steps of some minutes from since to a time; 0 for what lies before."""
    return F.greatest(F.floor((F.unix_seconds(time.cast("timestamp")) - F.unix_seconds(F.lit(since).cast("timestamp_ntz").cast("timestamp"))) / (60 * step)).cast("int"), F.lit(0))


def removals(told: DataFrame, gone: DataFrame, since: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of the removals that subscribers see: those after their first notification.

    told: email, state, first_sent; gone: rows with state, removed_at, by_address and property_id, removed after since. Of each
    state only the rows that are among the first n for some first_sent are sent on, each to the hours of first_sent for which
    it may be, so a subscriber meets about n rows a state. Counts come from a state's minutes, added up from the last, and the
    rows of the subscriber's own minute.
    """
    never = F.col("from_value").isNull()
    top = threshold_top(gone, "state", "removed_at", n, ("by_address", "property_id"))
    hours = F.explode(F.sequence(F.when(never, 0).otherwise(minutes(F.col("from_value"), since, 60)), minutes(F.col("removed_at"), since, 60)))
    people = told.withColumn("_hour", minutes(F.col("first_sent"), since, 60))
    rows = people.join(top.withColumn("_hour", hours), ["state", "_hour"]).where((F.col("first_sent") < F.col("removed_at")) & (never | (F.col("first_sent") >= F.col("from_value"))))
    minute = minutes(F.col("removed_at"), since, 1)
    per = gone.groupBy("state", minute.alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    later = F.coalesce(F.sum("_n").over(Window.partitionBy("state").orderBy(F.desc("_minute")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a minute that has removals or first notifications; the minutes of a state are few
    wanted = told.select("state", minutes(F.col("first_sent"), since, 1).alias("_minute"), F.lit(0).cast("long").alias("_n")).distinct()
    steps = per.unionByName(wanted).groupBy("state", "_minute").agg(F.sum("_n").alias("_n")).select("state", "_minute", later.alias("_later"))
    asked = told.withColumn("_minute", minutes(F.col("first_sent"), since, 1)).join(steps, ["state", "_minute"])
    same = told.withColumn("_minute", minutes(F.col("first_sent"), since, 1)).join(gone.select("state", minute.alias("_minute"), "removed_at"), ["state", "_minute"]).where(F.col("first_sent") < F.col("removed_at"))
    counts = asked.select("email", F.col("_later").alias("_n")).unionByName(same.groupBy("email").agg(F.count(F.lit(1)).alias("_n")))
    return rows.drop("first_sent", "_hour", "from_value"), counts.groupBy("email").agg(F.sum("_n").alias("_n")).withColumn("section", F.lit("Removed"))


def subscriber_digest(subscribers: DataFrame, states: DataFrame, properties: DataFrame, events: DataFrame, links: DataFrame | None, notifications: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Rows (SHOWN_FIELDS) of every eligible subscriber's digest, in one job.

    The first listings by date over all states of the subscriber and the first changes of each category by address; removals
    only for subscribers who were notified before. Listings and change groups of each state are made and written once; of each
    set of states and section the first rows and a count are fanned out, so what is sent to a subscriber does not grow with the
    listings, and neither does the grouping with the audience. more is what is left of the sum of the states' counts.
    """
    people = kept(eligible(subscribers).join(states, "subscriber_id").select("email", "state").distinct(), "people")
    none = F.lit(None)
    upcoming = filter_active(find_active(properties, events, links, as_of), as_of).withColumn("labels", F.array().cast("array<string>"))
    listed = upcoming.select(*FIELDS, F.lit("Upcoming").alias("section"), none.cast("timestamp_ntz").alias("removed_at"), F.col("auction_datetime").alias("by_date"), none.cast("string").alias("by_address"))
    changes = events_with_property(events.where(F.col("detected_at") >= at(as_of, -days)), hide_duplicates(properties, links))
    groups = aggregates.change_groups(changes, as_of, ("state", "address"))
    changed = groups.select(*FIELDS, F.col("category").alias("section"), "removed_at", none.cast("timestamp_ntz").alias("by_date"), F.col("address").alias("by_address"))
    rows = kept(listed.unionByName(changed), "digest-rows")
    sent = first_of_states(people, rows.where(F.col("section") != "Removed"), SHOWN, ORDER)
    told = people.join(notifications.groupBy("email").agg(F.min("sent_at").alias("first_sent")), "email")
    gone, gone_counts = removals(kept(told, "told"), rows.where((F.col("section") == "Removed") & F.col("state").isNotNull()), str_at(as_of, -days), SHOWN)
    more = gone_counts.withColumn("more", F.greatest(F.col("_n") - SHOWN, F.lit(0)))
    removed = first_rows(gone, ["email", "section"], SHOWN).join(more, ["email", "section"])
    return sent.select(*SHOWN_FIELDS).unionByName(removed.select(*SHOWN_FIELDS))


def listings_and_changes(subscribers: DataFrame, states: DataFrame, properties: DataFrame, events: DataFrame, as_of: str, days: int = 7, n: int = 25) -> DataFrame:
    """(email, section, rank, more, state, property_id, event_id) of what each eligible subscriber's states have.

    Sections: Listing, by date (undated first), and Change, the last days' events, the newest first; the first n of each over all states of
    a subscriber, more is what is left. The rows are ranked once for each set of states.
    """
    people = kept(eligible(subscribers).join(states, "subscriber_id").select("email", "state").distinct(), "people")
    none = F.lit(None)
    listed = properties.select("state", F.lit("Listing").alias("section"), "property_id", none.cast("long").alias("event_id"), F.unix_micros(F.col("auction_datetime").cast("timestamp")).alias("_by"))
    recent = events.where(F.col("detected_at") >= at(as_of, -days)).select("auction_id", "event_id", "detected_at")
    changed = recent.join(properties.select("auction_id", "property_id", "state"), "auction_id").select("state", F.lit("Change").alias("section"), "property_id", "event_id", (-F.unix_micros(F.col("detected_at").cast("timestamp"))).alias("_by"))
    rows = kept(listed.unionByName(changed), "state-rows")
    found = first_of_states(people, rows, n, ("_by", "property_id", "event_id"))
    return found.select("email", "section", "rank", "more", "state", "property_id", "event_id")


def status_view(properties: DataFrame, events: DataFrame, links: DataFrame | None, as_of: str, states: Sequence[str], paid: bool, days: int = 7, saved_states: Sequence[str] = ()) -> DataFrame:
    """The digest of a list of states (section, state, property_id, address, auction_datetime, labels), uncapped and ungated.

    Without a state, the subscriber's saved states count. More than one state, or four if paid, is an error.
    """
    clean = lambda xs: list(dict.fromkeys(s.strip().upper() for s in xs if s and s.strip()))
    asked, most = clean(states) or clean(saved_states), 4 if paid else 1
    if len(asked) > most:
        raise ValueError(f"at most {most} states")
    if not asked:
        asked = [""]
    active = filter_active(find_active(properties, events, links, as_of, asked), as_of)
    changes = find_recent_changes(events.where(F.col("detected_at") >= at(as_of, -days)), properties, links, str_at(as_of, -days), asked)
    groups = aggregates.change_groups(changes.withColumn("_state", F.col("state")), as_of, ("state", "address"))
    fields = ["section", "state", "property_id", "address", "auction_datetime", "labels"]
    none = F.array().cast("array<string>")
    return active.select(F.lit("Upcoming").alias("section"), "state", "property_id", "address", "auction_datetime", none.alias("labels")).unionByName(groups.select(F.col("category").alias("section"), *fields[1:]))


def str_at(as_of: str, days: int) -> str:
    from datetime import datetime, timedelta

    return str(datetime.fromisoformat(as_of) + timedelta(days=days))


def saved_property_alert(saved: DataFrame, events: DataFrame, properties: DataFrame, notifications: DataFrame, as_of: str) -> DataFrame:
    """Change groups of saved properties for each subscriber, removals gated."""
    rows = saved_changes(saved, events, notifications, as_of).withColumnRenamed("property_id", "auction_id")
    groups = aggregates.change_groups(events_with_property(rows, properties), as_of, ("email", "address"))
    gone = removed_gate(groups.where(F.col("category") == "Removed"), notifications)
    return groups.where(F.col("category") != "Removed").unionByName(gone.select(groups.columns))


def saved_alert_tags(saved: DataFrame, events: DataFrame, notifications: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Changes of saved properties in the last days, each tagged as sent before or new."""
    sent = notifications.where(F.col("kind") == "saved").groupBy("email").agg(F.max("sent_at").alias("_sent"))
    rows = events.where(F.col("event_type").isin("date_change", "disappeared", "status_change") & (F.col("detected_at") >= at(as_of, -days))).withColumnRenamed("auction_id", "property_id")
    tag = F.when(F.col("detected_at") <= F.col("_sent"), "sent").otherwise("new")
    return saved.join(rows, "property_id").join(sent, "email", "left").withColumn("tag", tag).drop("_sent")


def upcoming_auctions(properties: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return properties.where(F.col("auction_datetime").between(at(as_of), at(as_of, days)))


def new_listings(events: DataFrame, properties: DataFrame, since: str) -> DataFrame:
    return events_with_property(events.where((F.col("event_type") == "first_seen") & (F.col("detected_at") >= at(since))), properties)


def removed_union(events: DataFrame, properties: DataFrame, since: str, until: str, stale_days: int = 14, states: Sequence[str] | None = None) -> DataFrame:
    """(property_id, event_id, reason): every event in [since, until) that took a property off the map by its status, and the properties
    that went stale in it (event_id null) without such an event, unless their status had taken them off before."""
    rows, off = in_states(properties, states), lambda c: status.off_map(F.lower(F.col(c)))
    changed = events.where((F.col("event_type") == "status_change") & off("new_value") & (F.col("detected_at") >= at(since)) & (F.col("detected_at") < at(until)))
    told = changed.join(rows.select("auction_id", "property_id"), "auction_id").select("property_id", "event_id", F.lit("status").alias("reason"))
    crossed = F.col("last_seen_at") + F.make_dt_interval(F.lit(stale_days))
    old = rows.where((crossed >= at(since)) & (crossed < at(until)) & F.col("status").isNotNull() & ~off("status")).join(told.select("property_id").distinct(), "property_id", "left_anti")
    return told.unionByName(old.select("property_id", F.lit(None).cast("long").alias("event_id"), F.lit("stale").alias("reason")))


def payload(digest: DataFrame, as_of: str, base: str = "https://example.com/map") -> DataFrame:
    """(email, payload): a JSON object a subscriber with the digest's upcoming and change rows, each in its order.

    digest: rows of subscriber_digest(); they are capped, so an object's size is bounded.
    """
    dt = F.col("auction_datetime")
    row = F.struct(
        F.col("property_id").alias("propertyId"), "state", F.col("section").alias("category"), "address", F.coalesce(F.date_format(dt, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("auctionDateTime"), dates.day_header(dt).alias("day"),
        F.when(dt.isNull(), "date unknown").otherwise(dates.digest_time(dt)).alias("time"), "labels", "url", text.map_url(base, F.col("latitude"), F.col("longitude")).alias("map"), link_available(as_of).alias("linkAvailable"), F.col("more"),
    )
    rows = digest.groupBy("email").agg(F.array_sort(F.collect_list(F.struct(place(), "rank", row.alias("row")))).alias("rows"))
    pick = lambda on: F.transform(F.filter("rows", on), lambda x: x["row"])
    return rows.select("email", F.to_json(F.struct(pick(lambda x: x["place"] == 0).alias("upcoming"), pick(lambda x: x["place"] > 0).alias("changes"))).alias("payload"))


SECTIONS = ("Upcoming", "New", "Date Changes", "Status Changes", "Removed")
TITLES = ("Upcoming auctions", "New Listings", "Date Changes", "Status Changes", "Removed")


def place() -> Column:
    return (F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")) - 1).cast("int").alias("place")


def shown_link(as_of: str) -> Column:
    """How a row of a body is linked: not at all if removed or dateless, 'soon' for a new listing that is far off, else 'yes'."""
    dt, section = F.col("auction_datetime"), F.col("section")
    return F.when(dt.isNull() | (section == "Removed"), "no").when((section == "New") & ~link_available(as_of), "soon").otherwise("yes")


def render(digest: DataFrame, as_of: str, base: str = "https://example.com/map") -> DataFrame:
    """(email, plain, html): one body of each kind per subscriber.

    Upcoming rows stand under the header of their day, changes under that of their category with their labels as tags; a
    section that was cut ends with '+N more'. Rows are linked by shown_link(). A body holds the capped rows, so its size is bounded.
    """
    dt, link = F.col("auction_datetime"), text.map_url(base, F.col("latitude"), F.col("longitude"))
    esc = text.escape_html
    line = F.struct(
        place(), "rank", "more", F.when(F.col("section") == "Upcoming", dates.day_header(dt)).alias("day"), F.when(dt.isNull(), "date unknown").otherwise(dates.digest_time(dt)).alias("time"), F.coalesce("address", F.lit("")).alias("address"),
        "labels", F.coalesce("url", F.lit("")).alias("url"), link.alias("map"), shown_link(as_of).alias("linked"),
    )
    rows = digest.groupBy("email").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    title = lambda r: F.get(F.array(*map(F.lit, TITLES)), r["place"])

    def before(i: Column) -> Column:
        return F.get("rows", i - 1)

    def body(header, row, more) -> Column:
        """Every row with what goes before it (a new section, a new day) and after it (the remainder of its section)."""

        def one(r: Column, i: Column) -> Column:
            new = (i == 0) | (before(i)["place"] != r["place"])
            day = r["day"].isNotNull() & (new | ~before(i)["day"].eqNullSafe(r["day"]))
            last = F.coalesce(F.get("rows", i + 1)["place"] != r["place"], F.lit(True))
            return F.concat(F.when(new & r["day"].isNull(), header(title(r))).when(day, header(r["day"])).otherwise(""), row(r), F.when(last & (r["more"] > 0), more(r["more"].cast("string"))).otherwise(""))

        return F.array_join(F.transform("rows", one), "")

    tags = lambda r, a, b: F.array_join(F.transform(r["labels"], lambda x: F.concat(F.lit(a), esc(x) if a.startswith("<") else x, F.lit(b))), " ")
    plain = body(
        lambda t: F.concat(F.lit("== "), t, F.lit("\n")),
        lambda r: F.concat(
            F.lit("  "), r["time"], F.lit("  "), r["address"], F.when(F.size(r["labels"]) > 0, F.concat(F.lit("  "), tags(r, "[", "]"))).otherwise(""),
            F.when(r["linked"] == "yes", F.concat(F.lit("  "), r["url"])).when(r["linked"] == "soon", F.lit("  (soon)")).otherwise(""), F.lit("\n"),
        ),
        lambda n: F.concat(F.lit("  +"), n, F.lit(" more\n")),
    )
    anchor = lambda to, what: F.concat(F.lit(' <a href="'), esc(to), F.lit(f'">{what}</a>'))
    html = body(
        lambda t: F.concat(F.lit("<h3>"), esc(t), F.lit("</h3>\n")),
        lambda r: F.concat(
            F.lit("<p><b>"), esc(r["address"]), F.lit("</b> <time>"), r["time"], F.lit("</time> "), tags(r, "<mark>", "</mark>"),
            F.when(r["linked"] == "yes", F.concat(anchor(r["url"], "details"), F.when(r["map"] != "", anchor(r["map"], "map")).otherwise(""))).when(r["linked"] == "soon", F.lit(" <i>soon</i>")).otherwise(""), F.lit("</p>\n"),
        ),
        lambda n: F.concat(F.lit("<p>+"), n, F.lit(" more</p>\n")),
    )
    return rows.select("email", plain.alias("plain"), html.alias("html"))


def eligible(subscribers: DataFrame) -> DataFrame:
    return subscribers.where(F.col("active") & F.col("alerts") & F.col("subscription_status").isin("active", "trialing"))


def due_notifications(subscribers: DataFrame, notifications: DataFrame, as_of: str, hours: int = 4) -> DataFrame:
    """Eligible subscribers who were sent nothing in the last hours."""
    recent = notifications.where(F.col("sent_at") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))).select("email")
    return eligible(subscribers).join(recent, "email", "left_anti")


def due_welcome(subscribers: DataFrame, notifications: DataFrame) -> DataFrame:
    return eligible(subscribers).join(notifications.where(F.col("kind") == "welcome").select("email"), "email", "left_anti")


def set_states(current: DataFrame, requests: DataFrame, subscribers: DataFrame, valid: Sequence[str], as_of: str | None = None, starts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state table after the requests, rejected requests, start dates). requests: subscriber_id, states (comma-separated), seq.

    A request replaces all states of its subscriber; it is rejected if a state is unknown or there are more than one, or
    four for a paying subscriber, or the subscriber is not active. Of a subscriber's good requests the one with the highest
    seq counts (without seq, any one). starts: (subscriber_id, started_at); a subscriber's first good request sets it once.
    """
    asked = requests if "seq" in requests.columns else requests.withColumn("seq", F.lit(0))
    people = subscribers.where("active") if "active" in subscribers.columns else subscribers
    listed = asked.withColumn("list", text.state_list(F.col("states"))).join(people.select("subscriber_id", "subscription_status"), "subscriber_id", "left")
    most = F.when(F.col("subscription_status").isin("active", "trialing"), 4).otherwise(1)
    ok = F.coalesce(F.col("subscription_status").isNotNull() & (F.size("list") > 0) & (F.size("list") <= most) & (F.size(F.array_except("list", F.array(*map(F.lit, valid)))) == 0), F.lit(False))
    good = listed.where(ok).groupBy("subscriber_id").agg(F.max_by("list", "seq").alias("list"))
    new = current.join(good.select("subscriber_id"), "subscriber_id", "left_anti").select("subscriber_id", "state").unionByName(good.select("subscriber_id", F.explode("list").alias("state")))
    none = good.select("subscriber_id", F.lit(None).cast("timestamp_ntz").alias("started_at")).limit(0)
    old = starts if starts is not None else none
    began = old.join(good.select("subscriber_id", F.lit(as_of).cast("timestamp_ntz").alias("_now")), "subscriber_id", "full").select("subscriber_id", F.coalesce("started_at", "_now").alias("started_at"))
    return new, listed.where(~ok).select("subscriber_id", "states"), began
