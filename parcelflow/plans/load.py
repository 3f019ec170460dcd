"""One snapshot applied to the state: new, changed and vanished listings as events, and the next state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.functions import dates, text
from parcelflow.operators.aggregates import pdf_links
from parcelflow.operators.dedup import cross_source_repeats, latest_per_listing
from parcelflow.operators.joins import placed
from parcelflow.sources.files import kept

EVENTS = "event_id long, auction_id long, event_type string, old_value string, new_value string, detected_at timestamp_ntz, run_id long"
LINKS = "auction_id long, ord int, link string"
RUNS = "run_id long, as_of timestamp_ntz, found long, new long, changed long, removed long, failed long, cross_dropped long, last_property long, last_event long"
#: A property with its current auction. last_event is the kind of the last event of the auction.
STATE = (
    "property_id long, auction_id long, source string, listing_id string, address string, latitude double, longitude double, state string, county string, municipality string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
    "auction_datetime_raw string, auction_datetime timestamp_ntz, status string, description string, summary string, property_type string, bedrooms long, bathrooms double, sqft long, lot_size_raw string, year_built long, mortgage_ref string, "
    "metadata string, url string, last_updated_at timestamp_ntz, last_event string"
)
#: A snapshot's columns; those that one lacks count as null, and details as said in the description.
SNAPSHOT = (
    "seq long, source string, listing_id string, url string, name string, latitude double, longitude double, state string, county string, municipality string, auction_datetime_raw string, auction_datetime timestamp_ntz, status string, "
    "description string, summary string, property_type string, bedrooms long, bathrooms double, sqft long, lot_size_raw string, year_built long, mortgage_ref string, metadata string, pdf_links string"
)
#: What a known listing takes over from a snapshot, beside its place; the rest keeps its first value.
CURRENT = ("auction_datetime_raw", "auction_datetime", "status", "description", "summary", "property_type", "bedrooms", "bathrooms", "sqft", "lot_size_raw", "year_built", "mortgage_ref", "metadata", "url")
PLACE = ("state", "county", "municipality")
#: What names a listing; the first deals the stored state to parts.
KEYS = ("source", "listing_id")
#: The same as joins sort by them and the stored state is dealt to buckets: listing ids differ in their first letters, sources hardly do.
JOINED = ("listing_id", "source")


@dataclass
class Loaded:
    """state: the whole next state; events and links: those that the run adds; rejects: rows that could not be loaded; run: its counters;
    changes: the events with what load_snapshot() was asked to carry."""

    state: DataFrame
    events: DataFrame
    rejects: DataFrame
    links: DataFrame
    run: DataFrame
    changes: DataFrame


def typed(rows: DataFrame, as_of: str, **hosts: tuple[str, ...]) -> DataFrame:
    """A listing file's text columns as a snapshot: ids by the URL, dates and details parsed, explicit details before described ones.

    hosts: the host rules of extract_listing_id().
    """
    raw = lambda name: F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")
    columns = {"property_type": "Property Type", "bedrooms": "Bedrooms", "bathrooms": "Bathrooms", "sqft": "Sqft", "lot_size_raw": "Lot Size", "year_built": "Year Built"}
    found = text.property_details({k: raw(v) for k, v in columns.items()}, raw("Description"))
    values: dict[str, Column] = {
        "seq": F.col("seq"), "source": text.blank_to_null(raw("Source")), "listing_id": text.extract_listing_id(raw("URL"), raw("Name"), **hosts), "url": raw("URL"), "name": raw("Name"),
        "latitude": F.trim(raw("Latitude")).try_cast("double"), "longitude": F.trim(raw("Longitude")).try_cast("double"), **{k.lower(): F.coalesce(F.trim(raw(k)), F.lit("")) for k in ("State", "County", "Municipality")},
        "auction_datetime_raw": raw("Auction Date/Time"), "auction_datetime": dates.auction_datetime(raw("Auction Date/Time"), as_of), "status": F.lower(F.trim(raw("Status"))), "description": raw("Description"),
        "summary": text.blank_to_null(raw("Summary")), **found, "metadata": F.when(text.metadata_ok(raw("Metadata")), raw("Metadata")), "pdf_links": raw("PDF Links"),
    }
    return rows.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SNAPSHOT)))


def widened(snapshot: DataFrame) -> DataFrame:
    """snapshot with all columns of SNAPSHOT; those that it lacks are null."""
    column = lambda f: F.col(f.name) if f.name in snapshot.columns else F.lit(None)
    return snapshot.select(*(column(f).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SNAPSHOT)))


def described(rows: DataFrame, given: list[str]) -> DataFrame:
    """rows with the details that are not given as said in their description; parsed after repeats are gone."""
    found = text.parse_description(F.col("description"))
    if "bathrooms" not in given:  # the text and its sum are found once, in projections of their own
        rows = rows.withColumn("_baths", text.baths_text(F.col("description"))).withColumn("_sum", text.baths_sum(F.col("_baths")))
        found["bathrooms"] = text.read_bathrooms(F.col("_baths"), F.col("_sum"))
    return rows.withColumns({k: c for k, c in found.items() if k not in given}).drop("_baths", "_sum")


def rejected() -> Column:
    return F.col("latitude").isNull() | F.col("longitude").isNull() | F.col("listing_id").isNull() | F.col("source").isNull()


def split_rejects(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be loaded, and those without coordinates or a listing id, which change nothing."""
    return snapshot.where(~rejected()), snapshot.where(rejected())


def deduplicate(snapshot: DataFrame) -> DataFrame:
    return one_source(latest_per_listing(snapshot))


def one_source(latest: DataFrame) -> DataFrame:
    """latest, a row a listing, without the repeats of other sources: the join that drops them is on JOINED, as the comparison's."""
    return latest.join(repeats(latest), list(JOINED), "left_anti")


def repeats(latest: DataFrame) -> DataFrame:
    """The listings that another source's repeat, found on narrow rows."""
    narrow = latest.select(*KEYS, "seq", "latitude", "longitude")
    return cross_source_repeats(narrow, text.coord_key(F.col("latitude"), F.col("longitude"))).select(*JOINED)


def compared(rows: DataFrame, state: DataFrame | None, sources: Sequence[str]) -> DataFrame:
    """Every listing that the snapshot or the state has, by one outer join: source, listing_id, n_ and o_ columns of the new and the stored
    row, n_here and o_here (null where there is none), and made: the events (event_type, old_value, new_value) that their difference makes.

    A stored listing that is not there has disappeared if its source is in sources and its last event does not say so already.
    Where nothing is stored, state is None, nothing is joined and the rows stay dealt as they are.
    """
    side = lambda df, p: df.select(*KEYS, F.lit(True).alias(f"{p}_here"), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in KEYS))
    if state is None:
        both = side(rows, "n").select("*", F.lit(None).cast("boolean").alias("o_here"), *(F.lit(None).cast(f.dataType).alias(f"o_{f.name}") for f in T.StructType.fromDDL(STATE) if f.name not in KEYS))
    else:
        both = side(rows, "n").join(side(state, "o"), list(JOINED), "full")
    here, known, ran = F.col("n_here").isNotNull(), F.col("o_here").isNotNull(), F.col("source").isin(list(sources))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    event = lambda kind, a, b, on: F.when(on, F.struct(F.lit(kind).alias("event_type"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value")))
    made = F.array_compact(
        F.array(
            event("first_seen", F.lit(None), F.col("n_status"), here & ~known),
            event("status_change", F.col("o_status"), F.col("n_status"), here & known & ~F.col("o_status").eqNullSafe(F.col("n_status"))),
            event("date_change", time(F.col("o_auction_datetime")), time(F.col("n_auction_datetime")), here & known & ~F.col("o_auction_datetime").eqNullSafe(F.col("n_auction_datetime"))),
            event("disappeared", F.col("o_status"), F.lit(None), ~here & ran & ~F.col("o_last_event").eqNullSafe(F.lit("disappeared"))),
        )
    )
    return both.withColumn("made", made)


def counted(snapshot: DataFrame) -> dict[str | None, int]:
    """The sources that a snapshot has rows of, rejected ones too, with the number of these; a value a site."""
    return {r[0]: r[1] for r in snapshot.groupBy("source").agg(F.count_if(rejected())).collect()}


def sources_of(snapshot: DataFrame) -> list[str]:
    return sorted(r[0] for r in snapshot.select("source").where(F.col("source").isNotNull()).distinct().collect())


def load_snapshot(
    snapshot: DataFrame, state: DataFrame | None, as_of: str, run_id: int, next_property: int = 0, next_event: int = 0, counts: Mapping[str | None, int] | None = None,
    carried: Sequence[str] = (), by: Sequence[str] = JOINED, buckets: int | None = None,
) -> Loaded:
    """The state and the events after a snapshot. next_property and next_event: the highest ids in use; counts: counted(snapshot) if known;
    carried: columns of the next state that the changes are to have; by and buckets: how the state is dealt, if it is.

    Identity fields other than the place keep their first value; an empty snapshot changes nothing, and one whose rows are
    all rejected counts their sources as run. Loading the same snapshot again gives no event. state needs the snapshot's
    sources only, and is None where nothing is stored; the next state has the sources that it was given and those of the snapshot. Ids go by range over the
    events alone; events of known properties come first, by id, then the new ones by their place, an event each.

    The snapshot's whole rows are shuffled once and kept in buckets. Events come from a comparison of the columns that they need;
    the next state is a plan over the same buckets and ids, worked out where it is written, in tasks of one bucket each.
    """
    counts = counted(widened(snapshot)) if counts is None else counts
    usable, rejects = split_rejects(widened(snapshot))
    latest = kept(latest_per_listing(usable), "latest", by, buckets)
    rows = latest.join(kept(repeats(latest), "repeats"), list(JOINED), "left_anti")
    now = F.lit(as_of).cast("timestamp_ntz")
    here, known = F.col("n_here").isNotNull(), F.col("o_property_id")
    last = F.coalesce(F.try_element_at("made", F.lit(-1))["event_type"], F.col("o_last_event"))
    keep = lambda c, value: F.when(known.isNull(), value).otherwise(F.col(f"o_{c}"))
    values = {
        "property_id": known, "auction_id": F.col("o_auction_id"), "address": keep("address", F.col("n_name")), "first_seen_at": keep("first_seen_at", now), "last_event": last,
        **{c: keep(c, F.col(f"n_{c}")) for c in ("latitude", "longitude")}, **{c: F.when(here, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c in CURRENT},
        **{c: F.when(here, F.coalesce(F.col(f"n_{c}"), F.lit(""))).otherwise(F.col(f"o_{c}")) for c in PLACE}, **{c: F.when(here, now).otherwise(F.col(f"o_{c}")) for c in ("last_seen_at", "last_updated_at")},
    }
    ran = [x for x in counts if x is not None]
    told = described(rows, snapshot.columns)
    both = kept(compared(told, state, ran).select(*KEYS, known.alias("known"), "made", here.alias("_here"), F.col("n_seq").alias("_seq"), F.when(known.isNull(), F.col("n_pdf_links")).alias("_pdf_links"), *(values[c].alias(c) for c in carried)), "compared")
    moved = both.where(F.size("made") > 0).select(*KEYS, "known", "_seq", "_pdf_links", *carried, F.posexplode("made").alias("_nth", "e"))
    numbered = placed(moved, [F.asc_nulls_last("known"), F.col("_seq"), F.col("_nth")], old=F.col("known").isNotNull()).withColumn("_id", F.coalesce("known", F.lit(next_property + 1) + F.col("place") - F.col("old")))
    new = numbered.where(F.col("known").isNull())
    ided = compared(told.join(new.select(*KEYS, "_id"), list(JOINED), "left"), state, ran)
    values |= {c: F.coalesce(values[c], F.col("n__id")) for c in ("property_id", "auction_id")}
    after = ided.select(*(values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(STATE)))
    changes = numbered.select((F.lit(next_event + 1) + F.col("place")).cast("long").alias("event_id"), F.col("_id").alias("auction_id"), "e.*", now.alias("detected_at"), F.lit(run_id).cast("long").alias("run_id"), *carried)
    kinds = lambda *names: F.exists("made", lambda e: e["event_type"].isin(*names))
    count = both.agg(
        F.count_if("_here").alias("found"), F.count_if(kinds("first_seen")).alias("new"), F.count_if(kinds("status_change", "date_change")).alias("changed"), F.count_if(kinds("disappeared")).alias("removed"),
        F.coalesce(F.sum(F.size("made")), F.lit(0)).alias("events"),
    )
    run = count.select(
        F.lit(run_id).cast("long").alias("run_id"), now.alias("as_of"), "found", "new", "changed", "removed", F.lit(sum(counts.values())).cast("long").alias("failed"), (F.lit(latest.count()) - F.col("found")).alias("cross_dropped"),
        (F.lit(next_property) + F.col("new")).cast("long").alias("last_property"), (F.lit(next_event) + F.col("events")).cast("long").alias("last_event"),
    )
    links = pdf_links(new.select(F.col("_id").alias("property_id"), F.col("_pdf_links").alias("pdf_links"))).withColumnRenamed("property_id", "auction_id")
    return Loaded(after, changes.drop(*carried), rejects, links, run, changes)
